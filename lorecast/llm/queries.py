"""Queries of the operators for training data, by name: (callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from lorecast.functions.keys import is_blank, key
from lorecast.functions.roles import readable_role
from lorecast.llm import boilerplate, canonical, conversations, mixing, pairs, pii, tokens
from lorecast.session import table

#: The tables whose texts are brought to one form, with their id and text.
LOOKS = (("document_chunks", "id", "content"), ("eval_qa_pairs", "id", "question"))


def _of_tables(make, spark: SparkSession, d: str) -> DataFrame:
    parts = [make(table(spark, d, t), i, c).withColumn("table_name", F.lit(t)) for t, i, c in LOOKS]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _of_tables(canonical.look_alike_pairs, spark, d).select("table_name", "id_1", "id_2")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return _of_tables(canonical.look_alike_classes, spark, d)


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, t).select(F.lit(t).alias("table_name"), F.col(i).alias("id"), canonical.canonical(F.col(c)).alias("canonical"))
        for t, i, c in LOOKS
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped_conversations(table(spark, d, "messages"))


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuilt_conversations(table(spark, d, "messages"))


def p4_threads(spark: SparkSession, d: str) -> DataFrame:
    """Reasons where rows name what they answer: the row before them, or, for one in 32, the row after, which makes cycles and early answers."""
    m = table(spark, d, "messages")
    known = m.where(F.col("created_at").isNotNull() & ~is_blank(F.col("content"))).select(key("id").alias("_id"), key("conversation_id").alias("c"), "created_at", F.coalesce(readable_role(F.col("role")) == "assistant", F.lit(False)).alias("answers")).dropna().distinct()
    w = Window.partitionBy("c").orderBy("created_at", "answers", "_id")
    turned = F.substring(F.md5("_id"), 1, 2) < "08"
    links = known.select("_id", F.coalesce(F.when(turned, F.lead("_id").over(w)), F.lag("_id").over(w)).alias("reply"))
    return conversations.dropped_conversations(m.withColumn("_id", key("id")).join(links, "_id", "left"), "reply")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"), ["doc_id"], "text")


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decoded(p6_ids(spark, d), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_pii(table(spark, d, "documents"), ["doc_id"], "text")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), ["doc_id"], "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.marked_lines(table(spark, d, "document_chunks"), table(spark, d, "documents"))


def p5_main(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, d, "document_chunks"), table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "eval_qa_pairs"), table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(mixing.counted(table(spark, d, "documents")), "doc_id", table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = mixing.counted(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.actual_shares(mixing.mixed(docs, "doc_id", targets), docs, targets)


_BLANKS = "[\\s\\x{85}\\x{A0}\\x{AD}\\x{34F}\\x{180E}\\x{2000}-\\x{200F}\\x{2028}-\\x{202F}\\x{205F}-\\x{206F}\\x{3000}\\x{FE00}-\\x{FE0F}\\x{FEFF}]"
_ROLE = "CASE " + " ".join(f"WHEN r IN ({', '.join(chr(39) + x + chr(39) for x in spellings)}) THEN '{name}'" for name, spellings in conversations.ROLES.items()) + " END"
_CONVERSATIONS = f"""
WITH raw AS (SELECT nullif(lower(regexp_replace(conversation_id, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')), '') AS c, role, regexp_replace(lower(role), '[\\s[:punct:]：\\x{{A0}}\\x{{200B}}\\x{{FEFF}}]+', '', 'g') AS r, content, created_at FROM messages),
named AS (SELECT c, content, created_at, {_ROLE} AS role, lower(trim(role)) AS spelt FROM raw WHERE c IS NOT NULL),
kept AS (SELECT DISTINCT c, content, created_at, role, CASE WHEN role IS NULL THEN spelt END AS spelt FROM named WHERE NOT regexp_full_match(coalesce(content, ''), '{_BLANKS}*')),
turns AS (SELECT c, role, lag(role) OVER w AS before, lead(role) OVER w AS after FROM kept WHERE role <> 'system' AND created_at IS NOT NULL WINDOW w AS (PARTITION BY c ORDER BY created_at, role = 'assistant', md5(content))),
facts AS (SELECT c, bool_and(coalesce(role = 'system', false)) AS bare, bool_or(role IS NULL OR created_at IS NULL) AS fault FROM kept GROUP BY c),
orders AS (SELECT c, bool_or(role = 'assistant' AND before IS DISTINCT FROM 'user') AS twice, bool_or(role = 'user' AND after IS DISTINCT FROM 'assistant') AS missing FROM turns GROUP BY c),
reasons AS (SELECT a.c, CASE WHEN f.c IS NULL OR f.bare THEN 'empty' WHEN f.fault OR o.twice THEN 'broken' WHEN o.missing THEN 'missing_reply' END AS reason
  FROM (SELECT DISTINCT c FROM named) a LEFT JOIN facts f USING (c) LEFT JOIN orders o USING (c))
"""
_P4 = {
    "p4_found": _CONVERSATIONS + "SELECT c AS conversation_id, reason FROM reasons WHERE reason IS NOT NULL",
    "p4_conversations": _CONVERSATIONS
    + """SELECT c AS conversation_id, row_number() OVER (PARTITION BY c ORDER BY created_at, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, md5(content)) AS position, role, content, created_at
    FROM kept WHERE c IN (SELECT c FROM reasons WHERE reason IS NULL)""",
    "p4_threads": _CONVERSATIONS
    + f""", k AS (SELECT DISTINCT lower(trim(m.id)) AS id, nullif(lower(regexp_replace(conversation_id, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')), '') AS c, created_at, content, role, coalesce(regexp_replace(lower(role), '[\\s[:punct:]：\\x{{A0}}\\x{{200B}}\\x{{FEFF}}]+', '', 'g') IN ({", ".join(repr(x) for x in conversations.ROLES["assistant"])}), false) AS answers FROM messages m WHERE created_at IS NOT NULL AND id IS NOT NULL AND NOT regexp_full_match(coalesce(content, ''), '{_BLANKS}*')),
    t AS (SELECT *, md5(id)[1:2] < '08' AND lead(id) OVER (PARTITION BY c ORDER BY created_at, answers, id) IS NOT NULL AS turned, row_number() OVER (PARTITION BY c, created_at, content, role ORDER BY id) AS copy FROM k WHERE c IS NOT NULL),
    early AS (SELECT c, bool_or(turned) AS early FROM t WHERE copy = 1 GROUP BY 1)
    SELECT c AS conversation_id, CASE WHEN early AND coalesce(reason, '') <> 'empty' THEN 'broken' ELSE reason END AS reason FROM reasons LEFT JOIN early USING (c) WHERE reason IS NOT NULL OR early""",
}



def _looks(table_name: str, text: str) -> str:
    """SQL for (id, form, text): signs replaced one by one, joined letters taken apart, invisible signs left out, composed."""
    canon = canonical.canonicalizer()
    single = {chr(c): to for c in range(0x80, 0x10000) if not 0xD800 <= c <= 0xDFFF and len(to := canon.look(chr(c))) == 1 and to != chr(c)}
    several = {chr(c): to for c in range(0x80, 0x10000) if not 0xD800 <= c <= 0xDFFF and len(to := canon.look(chr(c))) > 1}
    quoted = lambda t: t.replace("'", "''")
    shown = f"translate({text}, '{quoted(''.join(single))}', '{quoted(''.join(single.values()))}')"
    for sign, to in several.items():
        shown = f"replace({shown}, '{sign}', '{to}')"
    gone = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in canonical.INVISIBLE)
    return f"SELECT DISTINCT '{table_name}' AS table_name, nullif(lower(trim(id)), '') AS id, nfc_normalize(regexp_replace({shown}, '[{gone}]', '', 'g')) AS form, {text} AS text FROM {table_name} WHERE {text} IS NOT NULL AND nullif(trim(id), '') IS NOT NULL"


def _p3_sql() -> dict[str, str]:
    rows = "WITH r AS (" + " UNION ALL ".join(_looks(t, c) for t, _, c in LOOKS) + "), s AS (SELECT * FROM r WHERE (table_name, form) IN (SELECT (table_name, form) FROM r GROUP BY table_name, form HAVING count(DISTINCT text) > 1)) "
    return {
        "p3_found": rows + "SELECT DISTINCT a.table_name, a.id AS id_1, b.id AS id_2 FROM s a JOIN s b USING (table_name, form) WHERE a.id < b.id AND a.text <> b.text",
        "p3_classes": rows
        + """SELECT table_name, id, min(id) OVER f AS class_id, t AS texts, count(*) OVER f - count(*) OVER (PARTITION BY table_name, form, text) AS links
        FROM s JOIN (SELECT table_name, form, count(DISTINCT text) AS t FROM s GROUP BY 1, 2) USING (table_name, form) WINDOW f AS (PARTITION BY table_name, form)""",
    }


_P3 = _p3_sql()
QUERIES = {"p7_mix": (p7_mix, None), "p7_shares": (p7_shares, None), "p2_found": (p2_found, None), "p5_found": (p5_found, None), "p5_main": (p5_main, None), "p8_found": (p8_found, None), "p8_redacted": (p8_redacted, None), "p6_ids": (p6_ids, None), "p6_decoded": (p6_decoded, "SELECT doc_id, coalesce(text, '') AS text FROM documents"), "p4_found": (p4_found, _P4["p4_found"]), "p4_conversations": (p4_conversations, _P4["p4_conversations"]), "p4_threads": (p4_threads, _P4["p4_threads"]), "p3_found": (p3_found, _P3["p3_found"]), "p3_classes": (p3_classes, _P3["p3_classes"]), "p3_canonical": (p3_canonical, None)}
