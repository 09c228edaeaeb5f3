"""What a message asks for, and how a question is brought into shape for retrieval: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How messages of each intent look.
GREETING = (
    r"^(hi|hey|hello|yo|sup|hola|heya)([\s!,\.]|$)",
    r"^(你好|您好|嗨|喂|哈喽|早|晚上好|下午好|各位好)",
    r"^(good\s)?(morning|afternoon|evening|night)",
    r"^(bye|goodbye|see\s?you|88|拜拜|再见|回见)",
    r"^(thanks?|thank\s?you|thx|谢谢|多谢|感谢|3q)",
    r"^say\s+(hi|hello|hey|bye)",
    r"^(ok|okay|好的|收到|明白了|知道了|嗯嗯|哦哦)\s*$",
    r"^(how\s+are\s+you|你怎么样|最近如何)",
)
META = (
    r"(你能做什么|你可以做什么|你能干嘛|what\s+can\s+you\s+do)",
    r"(你是谁|你叫什么|who\s+are\s+you|你是什么)",
    r"(怎么用你|如何使用|how\s+to\s+use|help|帮助|使用说明)",
    r"(你支持什么|你有哪些功能|你有什么能力)",
    r"(你是谁开发的|谁做的|谁创造了你)",
)
CLARIFICATION = (
    r"^(什么|啥|哪个|怎么|为什么|为啥|能|可以|能不能|可不可以)",
    r"^(举个例子|举例|比如|例如|具体|详细|展开|再说)",
    r"^(没懂|不明白|不懂|不清楚|没理解|解释一下|再讲|再说一遍)",
    r"^(然后呢|接下来|继续|还有吗|还有呢)",
    r"^(就这|完了|就这样|没了)",
    r"^(不对|不是|错了|有问题|不行|不可以)",
    r"^(上面|前面|刚才|刚刚|之前).*(说|讲|提到|那个|这个)",
    r"^(代码|运行|执行|试试|测试).*",
)
TOOL = (
    r"(现在|当前|目前)\s*(时间|时候|几点)",
    r"(今天|明天|昨天)\s*(日期|几号|星期|周)",
    r"(时间|日期|年月日)\s*(查询|查看|现在|当前)",
    r"^\d+\s*[+\-*/×÷]\s*\d+",
    r"(等于|计算结果)",
    r"(加|减|乘|除|乘以|除以|plus|minus|times)",
    r"(多少)\s*(加|减|乘|除|plus|minus|times)",
    r"今天.*(天气|温度|下雨|下雪|刮风)",
    r"(天气|温度|下雨|下雪|刮风|台风|湿度)",
    r"(换算|转换|转).*(单位|货币|汇率|美元|人民币|欧元|公里|英里|英尺|英寸|厘米|公斤|斤|磅)",
    r"(美元|人民币|欧元|日元|英镑).*(汇率|兑|换|换算|等于多少)",
    r"\d+\s*(公里|千米|米|厘米|毫米|英寸|英尺|公斤|斤|磅).*(多少|等于|换算)",
)
KNOWLEDGE = (
    "python", "代码", "编程", "函数", "变量", "循环", "条件", "异常", "错误", "类", "对象", "模块", "导入", "文件", "字符串", "列表",
    "字典", "元组", "集合", "数组", "算法", "数据结构", "数据库", "前端", "后端", "框架", "库", "包", "接口", "API", "测试",
    "调试", "部署", "环境", "配置", "版本", "命令行", "终端", "怎么写", "怎么用", "如何", "怎样", "什么是", "什么意思",
    "区别", "对比", "比较", "优缺点", "选择", "什么时候", "报错", "出错", "不工作", "bug", "问题", "修复", "解决",
    "语法", "用法", "示例", "例子", "教程", "文档", "设计模式", "架构", "重构", "优化", "性能",
    "tcp", "http", "https", "redis", "mysql", "sql", "docker", "hashmap", "arraylist", "linkedlist", "hashset",
    "线程", "进程", "协程", "锁", "事务", "索引", "缓存", "队列", "消息队列", "中间件", "微服务", "分布式", "多线程", "线程池", "线程安全", "同步", "异步",
    "jvm", "jdk", "jre", "maven", "gradle", "tomcat", "spring", "springboot", "mybatis", "hibernate",
    "三次握手", "四次挥手", "协议", "网络", "操作系统", "内存管理", "垃圾回收", "类加载", "反射", "容器", "kubernetes", "k8s", "devops",
    "时间复杂度", "空间复杂度", "排序", "查找", "快速排序", "归并排序", "冒泡排序", "二分查找", "动态规划", "面向对象", "继承", "多态", "封装", "抽象类",
    "how to", "what is", "why does", "explain", "define", "difference between", "compare", "example of", "tutorial",
    "syntax", "usage", "error", "exception", "function", "variable", "class", "object", "import", "module", "package", "framework",
    "algorithm", "data structure", "design pattern", "thread", "process", "coroutine", "mutex", "deadlock",
    "dependency injection", "ioc", "aop", "rest", "restful", "graphql", "websocket", "oauth", "jwt", "nosql",
)
SHORT, TINY, LONGEST = 30, 8, 512
# Fillers at either end of a question, punctuation in two widths, and words in full width.
LEADING = (
    r"^(嗯|呃|啊|哦|噢|那个|这个|就是|就是说|我想问|我想知道|请问一下|问一下|问个问题)",
    r"^(um+|uh+|er+|hmm+|well,?\s|so,?\s|like,?\s)",
    r"^(那个啥|那个什么|内个|那啥)",
)
TRAILING = (
    r"(谢谢|感谢|多谢|3q|thanks?|thank\s?you)\s*$",
    r"(啊|吧|吗|呢|嘛|呗|呐|哦|噢|咯|啦|呀|哈)\s*$",
    r"(可以吗|行吗|对吗|好吗|OK吗|可以么|行么)\s*$",
)
WIDE, NARROW = "？！，。；：（）【】《》＂＇～％＠＃＆＊＋－／＝", "?!,.;:()[]<>\"'~%@#&*+-/="
WIDE_WORDS = {"ｐｙｔｈｏｎ": "python", "ＰＹＴＨＯＮ": "python"}
# What refers back, what history may name, and abbreviations with what they stand for, in order.
PRONOUN = r"\b(它|他|她|这个|那个|这些|那些)\b"
REFERS = PRONOUN + r"|\b(其|该)\b|\b(这样|那样|这么|那么|这般|那般)\b|\b(上面|前面|以上|上述|之前|刚才|刚刚)\b|\b(下面|以下|后面|之后)\b"
ENTITY = (
    r"(?i)\b(tuple|list|dict|set|str|int|float|bool|class|def|function|module|package|import|lambda|decorator|generator|coroutine|async|await|thread|process|exception|error|"
    r"for|while|if|else|elif|with|try|except|raise|yield|return|元组|列表|字典|集合|字符串|函数|类|模块|异常|循环|条件|装饰器|生成器|协程|异步|线程|进程|变量|参数|返回值)\b"
)
ABBREVIATIONS = {
    "oop": "面向对象编程", "OOP": "面向对象编程", "Oop": "面向对象编程", "ml": "机器学习", "ML": "机器学习", "dl": "深度学习", "DL": "深度学习", "nlp": "自然语言处理", "NLP": "自然语言处理",
    "api": "API 接口", "sdk": "SDK 开发工具包", "ide": "IDE 集成开发环境", "cli": "CLI 命令行", "rest": "REST API", "crud": "CRUD 增删改查", "sql": "SQL 数据库查询", "nosql": "NoSQL 非关系型数据库",
    "json": "JSON 数据格式", "csv": "CSV 文件", "yaml": "YAML 配置文件", "git": "Git 版本控制", "http": "HTTP 协议", "https": "HTTPS 协议", "ssh": "SSH 远程连接",
}
# What keeps a question from being searched as it stands.
TOO_PLAIN = ("如何", "怎样", "什么时候", "怎么写", "怎么用")
POINTS_BACK = r"(它|他|她|这个|那个|这些|那些|其|该|这样|那样)"
OPEN_ENDED = r"(分析|评价|比较|对比|说说|谈谈|看法|建议|你觉得|你认为|如何看|怎么看待|有什么(建议|想法|意见|方法|方案)|哪个好|选哪个|举个)"
ADDRESSES = r"(你|您)"
GENERIC_START = r"^(为什么|怎么|如何|哪个|什么|怎样|有啥|为啥|好不好|能不能|会不会|可不可以|有没有|是不是|有什么)"
SPECIFIC = r"(?i)(python|java|redis|mysql|tcp|http|docker|线程|进程|协程|锁|事务|索引|缓存|算法|数据结构|协议|网络|操作系统|框架|库|类|对象|函数|接口|hashmap|jvm|spring|kubernetes)"
FRAGMENT = r"^(什么|啥|哪个|怎么|为什么|为啥|哪一[个种]|好不好|能不能|会不会|可不可以|多少钱|多久|多大|多少|谁|哪里|何时|为何)$"
EARLIER = r"(上面|前面|刚才|之前|上述)"
READY_SIGNS, GENERIC_SIGNS, KEPT_ENTITIES, KEPT_TERMS = 6, 60, 5, 5
# Words of arithmetic in the order in which they are replaced.
OPERATORS = (("加", "+"), ("减去", "-"), ("减", "-"), ("乘以", "*"), ("乘", "*"), ("除以", "/"), ("除", "/"), ("等于", "="))


def _any(patterns) -> str:
    return "(?i)" + "|".join(patterns)


def intent(text: Column) -> Column:
    """greeting, meta, clarification, tool or knowledge by ordered rules; null where rules don't tell, and for null.

    Greetings and questions about the system come first. A short message that refers back is a clarification, unless it names
    something to know or to do. What names neither and is very short is a clarification too.
    """
    bare = F.trim(text)
    know = bare.rlike("(?i)" + "|".join(rf"\Q{w}\E" for w in KNOWLEDGE))
    tool = bare.rlike(_any(TOOL))
    refers = (F.length(bare) <= SHORT) & bare.rlike(_any(CLARIFICATION))
    return (
        F.when(bare.rlike(_any(GREETING)), "greeting").when(bare.rlike(_any(META)), "meta").when(refers & know, "knowledge").when(refers & tool, "tool")
        .when(refers, "clarification").when(tool, "tool").when(know, "knowledge").when(F.length(bare) <= TINY, "clarification")
    )


def cleaned_question(text: Column) -> Column:
    """Without fillers at the ends, narrow punctuation, no control characters, single spaces, at most 512 signs; never emptied."""
    bare = F.trim(text)
    inner = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, _any(LEADING), "")), _any(TRAILING), ""))
    narrow = F.translate(inner, WIDE, NARROW)
    for wide, word in WIDE_WORDS.items():
        narrow = F.replace(narrow, F.lit(wide), F.lit(word))
    plain = F.regexp_replace(narrow, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    short = F.substring(F.regexp_replace(plain, r"[ \t\n\r\f]{2,}", " "), 1, LONGEST)
    return F.when(short != "", short).otherwise(bare)


def prompt(contexts: Column, history: Column, question: Column) -> Column:
    """The first five contexts, the last six turns (role, content) and the question as one text."""
    parts = F.array_join(F.transform(F.slice(contexts, 1, 5), lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    turns = F.array_join(F.transform(F.slice(history, F.greatest(F.size(history) - 5, F.lit(1)), F.lit(6)), lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return F.concat_ws("\n\n", F.nullif(parts, F.lit("")), F.nullif(turns, F.lit("")), question)


def footnote(answer: Column, sources: Column) -> Column:
    """``answer`` with up to three sources (title, content) quoted below it, unless it has marks like [1] already."""
    quoted = F.array_join(F.transform(F.slice(sources, 1, 3), lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["title"], F.lit(": "), F.substring(s["content"], 1, 80))), "\n")
    return F.when(answer.rlike(r"\[\d+\]") | (F.size(sources) <= 0), answer).otherwise(F.concat(answer, F.lit("\n\n"), quoted))


def entities(history: Column) -> Column:
    """The up to five terms last named in the last six turns (role, content), those of the assistant before the user's, each once."""
    recent = F.slice(history, F.greatest(F.size(history) - 5, F.lit(1)), F.lit(6))
    said = lambda role: F.flatten(F.transform(F.filter(recent, lambda t: t["role"] == role), lambda t: F.regexp_extract_all(F.coalesce(t["content"], F.lit("")), F.lit(ENTITY), F.lit(1))))
    back = F.reverse(F.concat(said("assistant"), said("user")))
    last = lambda terms: F.filter(terms, lambda x, i: F.array_position(F.transform(terms, F.lower), F.lower(x)) == i + 1)
    return F.reverse(F.slice(F.get(F.transform(F.array(back), last), F.lit(0)), 1, KEPT_ENTITIES))


def resolved(question: Column, named: Column) -> Column:
    """``question`` with what refers back replaced by the first of the entities ``named``, or with that put before it."""
    first = F.get(named, F.lit(0))
    inner = F.regexp_replace(question, F.lit(PRONOUN), F.regexp_replace(first, r"([\\$])", r"\\$1"))
    return F.when((F.size(named) <= 0) | ~question.rlike(REFERS), question).when(inner != question, inner).otherwise(F.concat_ws(" ", first, question))


def spelled_out(text: Column, whole_words: bool = True) -> Column:
    """Abbreviations replaced one after the other; with ``whole_words`` only where no letter or digit of Latin stands beside them."""
    for short, full in ABBREVIATIONS.items():
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_]){short}(?![A-Za-z0-9_])", full) if whole_words else F.replace(text, F.lit(short), F.lit(full))
    return text


def retrieval_ready(text: Column, turns: Column) -> Column:
    """Whether a question names something to look for and stands for itself; ``turns`` is the number of turns before it."""
    q = F.trim(text)
    terms = "(?i)" + "|".join(rf"\Q{w}\E" for w in KNOWLEDGE if w not in TOO_PLAIN)
    vague = q.rlike(GENERIC_START) & (F.length(q) < GENERIC_SIGNS) & ~q.rlike(SPECIFIC)
    points = q.rlike(POINTS_BACK) | (turns >= 2) & q.rlike(EARLIER)
    return F.coalesce((F.length(q) >= READY_SIGNS) & q.rlike(terms) & ~points & ~q.rlike(OPEN_ENDED) & ~q.rlike(ADDRESSES) & ~vague & ~q.rlike(FRAGMENT), F.lit(False))


def appended(text: Column, terms: Column) -> Column:
    """``text`` with the first five of ``terms`` behind it, as far as it does not hold them already."""
    fresh = F.filter(F.slice(terms, 1, KEPT_TERMS), lambda t: ~F.contains(F.lower(text), F.lower(t)))
    return F.when(F.size(fresh) > 0, F.concat_ws(" ", text, F.array_join(fresh, " "))).otherwise(text)


def arithmetic(text: Column) -> Column:
    """What of a question is arithmetic: operators instead of words, nothing from an equals sign on."""
    for word, sign in OPERATORS:
        text = F.replace(text, F.lit(word), F.lit(sign))
    return F.trim(F.regexp_replace(F.substring_index(text, "=", 1), r"[^0-9+\-*/().,%\s]", ""))
