"""The tables of words, whole."""

import pytest
from pyspark.sql import functions as F

from lorecast.functions import questions as Q

READ = """
python|代码|编程|函数|变量|循环|条件|异常|错误|类|对象|模块|导入|文件|字符串|列表|字典|元组|集合|数组|算法|数据结构|数据库|前端|后端|框架|库|包|接口|API|测试|调试|部署|环境|配置|版本|命令行|终端|
怎么写|怎么用|如何|怎样|什么是|什么意思|区别|对比|比较|优缺点|选择|什么时候|报错|出错|不工作|bug|问题|修复|解决|语法|用法|示例|例子|教程|文档|设计模式|架构|重构|优化|性能|tcp|http|https|
redis|mysql|sql|docker|hashmap|arraylist|linkedlist|hashset|线程|进程|协程|锁|事务|索引|缓存|队列|消息队列|中间件|微服务|分布式|多线程|线程池|线程安全|同步|异步|
jvm|jdk|jre|maven|gradle|tomcat|spring|springboot|mybatis|hibernate|三次握手|四次挥手|协议|网络|操作系统|内存管理|垃圾回收|类加载|反射|容器|kubernetes|
k8s|devops|时间复杂度|空间复杂度|排序|查找|快速排序|归并排序|冒泡排序|二分查找|动态规划|面向对象|继承|多态|封装|抽象类|how to|what is|why does|explain|define|
difference between|compare|example of|tutorial|syntax|usage|error|exception|function|variable|class|object|import|module|
package|framework|algorithm|data structure|design pattern|thread|process|coroutine|mutex|deadlock|dependency injection|
ioc|aop|rest|restful|graphql|websocket|oauth|jwt|nosql
""".replace("\n", "").split("|")


def test_the_whole_table_of_keywords():
    assert len(READ) == len(set(READ)) == 172
    assert sorted(Q.KNOWLEDGE) == sorted(READ)


def test_each_keyword_alone_is_told(spark):
    """In a text too long to be a clarification; only rules that come earlier may decide otherwise."""
    rows = spark.createDataFrame([(w, f"zz {w} " + "z" * 40) for w in READ], "w string, t string").select("w", Q.intent(F.col("t")).alias("v")).collect()
    assert {r.w: r.v for r in rows if r.v != "knowledge"} == {"类加载": "tool"}  # 加, of the calculator's rule


@pytest.mark.parametrize("text", ["tcp", "Redis", "mysql", "docker", "jvm", "spring", "oauth", "JWT", "队列", "异步", "排序", "继承", "网络", "操作系统"])
def test_short_messages_of_one_keyword(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(Q.intent(F.col("t")).alias("v")).first().v == "knowledge"


@pytest.mark.parametrize(
    ("text", "want"),
    [("用列表OK吗", "用列表"), ("用列表可以么", "用列表"), ("用列表行么 ", "用列表"), ("那啥 列表", "列表"), ("内个列表", "列表"), ("那个啥列表", "啥列表"), ("用列表可以吗", "用列表")],
)
def test_fillers(spark, text, want):
    """Of the fillers in front the first that fits goes."""
    assert spark.createDataFrame([(text,)], "t string").select(Q.cleaned_question(F.col("t")).alias("v")).first().v == want
