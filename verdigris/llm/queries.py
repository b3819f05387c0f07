"""Driver queries of the training-data operators (problems 1 and 5 to 8), with their SQL twins where SQL can say it."""

from __future__ import annotations

import importlib
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _operator(name: str) -> ModuleType:
    """An operator's module, loaded when a query needs it: a missing dependency of one leaves the others usable."""
    return importlib.import_module(f"verdigris.llm.{name}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pairs(spark: SparkSession, folder: str, min_support: int) -> DataFrame:
    return _operator("cooccurrence").surprising_pairs(table(spark, folder, "decisions"), "decision_id", "ruleset_id", "matched_rule_ids", min_support)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rules in at least 10 common decisions and three times as many as their counts let expect."""
    strong = _pairs(spark, folder, 10).filter("n_ab * n >= 3 * n_a * n_b")
    return strong.select(F.col("item_a").alias("rule_id_a"), F.col("item_b").alias("rule_id_b")).distinct()


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of rules with a common decision, its expectation and its surprise."""
    return _pairs(spark, folder, 1).withColumnsRenamed({"group_key": "ruleset_id", "item_a": "rule_id_a", "item_b": "rule_id_b"})


def p1_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rules that occur together more often than the null allows, at a false-discovery rate of one in a hundred."""
    found = _pairs(spark, folder, 1).filter(F.col("log_q") <= F.log(F.lit(0.01)))
    return found.select(F.col("group_key").alias("ruleset_id"), F.col("item_a").alias("rule_id_a"), F.col("item_b").alias("rule_id_b"), "n_ab", "expected", "log_p", "log_q")


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Exact pair counts alone."""
    _, counted = _operator("cooccurrence").pair_counts(table(spark, folder, "decisions"), "decision_id", "ruleset_id", "matched_rule_ids")
    return counted.withColumnsRenamed({"group_key": "ruleset_id", "item_a": "rule_id_a", "item_b": "rule_id_b"})


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    fields = {
        "matched_rule_ids": _operator("terms").list_terms(table(spark, folder, "decisions"), "decision_id", "matched_rule_ids"),
        "target_field": _operator("terms").row_terms(table(spark, folder, "assignment_results"), "result_id", "decision_id", "target_field"),
    }
    return _operator("terms").term_frequencies(fields, rare_records=3, common_one_in=25)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that are too rare or too common."""
    return _terms(spark, folder).filter("band != 'usual'").select("field_name", "term_value", "band")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and decisions of every value."""
    return _terms(spark, folder)


def _sizes(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, int]]:
    limits = {r["limit_name"]: r["capacity_tokens"] for r in table(spark, folder, "pack_limits").collect()}  # a row per size
    return _operator("packing").token_counts(table(spark, folder, "documents"), "doc_id", "text"), limits


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in containers of each size."""
    return _operator("packing").pack(*_sizes(spark, folder))


def p6_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in one layout with windows of all sizes, and step groups that mix them."""
    return _operator("packing").pack_tiers(*_sizes(spark, folder))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each size are."""
    return _operator("packing").fill_report(p6_pack(spark, folder))


def _leaks(spark: SparkSession, folder: str, **options) -> DataFrame:
    return _operator("leakage").leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "item_text", **options)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 20 words of an item in runs of eight or more."""
    return _leaks(spark, folder).filter("exact_words >= 20").select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """All verified overlaps, with and without substituted words."""
    return _leaks(spark, folder)


def p7_leaks_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The same overlaps by the way that item sets too large for every task take."""
    return _leaks(spark, folder, broadcast_words=0)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that differ as stored but read the same."""
    return _operator("lookalike").look_alike_pairs_of_documents(table(spark, folder, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of texts that read the same."""
    return _operator("lookalike").look_alike_documents(table(spark, folder, "documents"), "doc_id", "text").drop("form")


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_surprise, p1_counts, p5_found, p5_terms, p6_pack, p6_tiers, p6_fill, p7_found, p7_leaks, p7_leaks_shuffled, p8_found, p8_classes)}

_P1 = """
with d as (select distinct decision_id, ruleset_id, list_sort(list_distinct(matched_rule_ids)) ids from decisions
           where decision_id is not null and ruleset_id is not null and len(list_distinct(matched_rule_ids)) > 0),
e as (select decision_id, ruleset_id, unnest(ids) r from d),
nn as (select ruleset_id, count(*) n from d group by 1),
c as (select a.ruleset_id, a.r rule_id_a, b.r rule_id_b, count(*) n_ab from e a join e b using (decision_id, ruleset_id)
      where a.r <= b.r group by all)
"""
_P5 = """
with d as (select distinct decision_id, list_filter(matched_rule_ids, lambda x: x is not null) ids from decisions where decision_id is not null),
x as (select 'matched_rule_ids' field_name, decision_id, unnest(ids) term_value, 1 k from d
      union all
      select 'target_field', decision_id, target_field, 1 from (select distinct result_id, decision_id, target_field from assignment_results
        where result_id is not null and decision_id is not null and target_field is not null)),
t as (select field_name, count(distinct decision_id) all_records from x group by 1),
g as (select field_name, term_value, count(*) occurrences, count(distinct decision_id) n_records from x group by 1, 2),
f as (select g.*, all_records, case when n_records <= 3 then 'rare' when n_records * 25 > all_records then 'common' else 'usual' end band from g join t using (field_name))
"""
# One form of texts in SQL, by composition and tables of single characters; it knows nothing of classes or automata.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_KANA = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ", "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"
_OTHER = "ɡօавсԁеһіјӏорԛѕԝхуνοАВСЕНІЈКМОРЅТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧёЁїЇ", "goaвcdehijlopqswxyvoABCEHIJKMOPSTXУABEZHIKMNOPTYXëËïÏ"
_JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj"}


def _form_sql(text: str) -> str:
    out = f"regexp_replace({text}, '[\\x{{ad}}\\x{{34f}}\\x{{61c}}\\x{{180b}}-\\x{{180f}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}]', '', 'g')"
    out = f"regexp_replace({out}, '[\\t\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    out = f"replace(regexp_replace({out}, '[\\x{{2010}}\\x{{2011}}\\x{{fe63}}\\x{{ff0d}}]', '-', 'g'), chr(13) || chr(10), chr(10))"
    for joined, plain in _JOINED.items():
        out = f"replace({out}, '{joined}', '{plain}')"
    for source, target in (_WIDE, _KANA, _OTHER):
        quoted = [t.replace("'", "''") for t in (source, target)]
        out = f"translate({out}, '{quoted[0]}', '{quoted[1]}')"
    return f"nfc_normalize({out})"


_P7 = f"""
with i as (select distinct item_id, regexp_extract_all(lower({_form_sql('item_text')}), '[\\p{{L}}\\p{{N}}]+') w from eval_items where item_id is not null and item_text is not null),
d as (select distinct doc_id, regexp_extract_all(lower({_form_sql('text')}), '[\\p{{L}}\\p{{N}}]+') w from documents where doc_id is not null and text is not null),
gi as (select item_id, j, array_to_string(w[j + 1 : j + 8], ' ') g from (select item_id, w, unnest(range(greatest(len(w) - 7, 0))) j from i)),
own as (select g from gi group by g having count(distinct item_id) = 1),
gd as (select distinct doc_id, array_to_string(w[j + 1 : j + 8], ' ') g from (select doc_id, w, unnest(range(greatest(len(w) - 7, 0))) j from d)),
hit as (select distinct doc_id, item_id, unnest(range(j, j + 8)) k from gi join own using (g) join gd using (g))
select doc_id, item_id from hit group by all having count(*) >= 20"""
_P8 = f"with d as (select distinct doc_id, text, {_form_sql('text')} form from documents where doc_id is not null and text is not null)"
SQL = {
    "p7_found": _P7,
    "p8_found": _P8 + " select distinct least(a.doc_id, b.doc_id) doc_id_a, greatest(a.doc_id, b.doc_id) doc_id_b from d a join d b on a.form = b.form and a.text <> b.text and a.doc_id <> b.doc_id",
    "p8_classes": _P8 + " select doc_id, min(doc_id) over (partition by form) class_id, count(*) over (partition by form) n_documents, (select count(distinct text) from d o where o.form = d.form) n_forms from d",
    "p1_found": _P1
    + """select distinct c.rule_id_a, c.rule_id_b from c join nn using (ruleset_id)
         join c a on a.ruleset_id = c.ruleset_id and a.rule_id_a = c.rule_id_a and a.rule_id_b = c.rule_id_a
         join c b on b.ruleset_id = c.ruleset_id and b.rule_id_a = c.rule_id_b and b.rule_id_b = c.rule_id_b
         where c.rule_id_a < c.rule_id_b and c.n_ab >= 10 and c.n_ab * n >= 3 * a.n_ab * b.n_ab""",
    "p1_counts": _P1 + "select * from c",
    "p5_found": _P5 + "select field_name, term_value, band from f where band <> 'usual'",
    "p5_terms": _P5 + "select * from f",
}
