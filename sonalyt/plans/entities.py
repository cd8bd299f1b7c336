"""Queries that tag references; texts are made from rows in a way that tells their tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities, languages
from ..operators import entities as scores
from .queries import query, rounded, table

_SAID = """concat('Met on ', case when l_linenumber % 2 = 0 then '{d}12/05/2024{/d}' else '{d}may 3{/d}' end, ' to pay {c}$', cast(l_quantity as int), '{/c} or {c}twenty one euros{/c}, ref {i}x', l_partkey, 'y{/i} phone {i}', 10000000 + l_orderkey, '{/i} since {d}', 1990 + l_linenumber, '{/d} for {n}two{/n} days with {p}Ann Lee{/p}, then we may go')"""
_TAGS = {"d": "date", "c": "currency", "i": "id", "n": "number", "p": "name"}


def _as(text: str, tagged: bool) -> str:
    for k, name in _TAGS.items():
        text = text.replace("{%s}" % k, f"<{name}>" if tagged else "").replace("{/%s}" % k, f"</{name}>" if tagged else "")
    return text


def _tagged(rows: DataFrame, tagger: Column, said: Column | None = None) -> DataFrame:
    """Tagged texts and how many clips have each; rows: the columns that a text is made of, or the text as said. A text that many clips share is tagged once, and the shuffle by those columns, which are shorter than the text, deals the others out, however few files or row groups they come from."""
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).select((F.col("said") if said is None else said).alias("said"), "n")
    return once.select(tagger.alias("tagged"), "n").groupBy("tagged").agg(F.sum("n").alias("clips"))


@query(f"select {_as(_SAID, True)} as tagged, count(*) as clips from lineitem group by 1")
def tagged_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with dates, amounts, ids, numbers and names, tagged by rule."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("l_quantity"), "l_partkey", "l_orderkey")
    return _tagged(rows, entities.tagged_by_rule(F.col("said"), F.lit("en-US")), F.expr(_as(_SAID, False)))


@query("select concat('wake me <date>tomorrow ', l_linenumber, '</date> and play rock for <name>Ann ', l_returnflag, '</name> at <currency>five dollars</currency>') as tagged, count(*) as clips from lineitem group by 1")
def slot_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose slots were marked by hand, with the rules over the rest."""
    marked = F.concat(F.lit("wake me [date : tomorrow "), "l_linenumber", F.lit("] and play [music_genre : rock] for [ person : Ann "), "l_returnflag", F.lit(" ] at five dollars"))
    return _tagged(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag"), entities.tagged_by_slots(F.col("said"), F.lit("en")), marked)


@query("with n as (select distinct cast(l_quantity as int) as n from lineitem) select n, cast(n as varchar) as number, concat('ab', n, 'c') as id, concat('room ', n) as name from n")
def slot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written values of slots in the form in which they are compared."""
    words = F.create_map(*[x for n in range(100) for x in (F.lit(n), F.lit(languages.spell(n, "en")))])
    n = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("n")).distinct().withColumn("w", F.element_at(words, F.col("n")))
    en = F.lit("en")
    return n.select(
        "n", entities.canonical(F.lit("number"), F.concat(F.lit("No. "), "w"), en).alias("number"), entities.canonical(F.lit("id"), F.concat(F.lit("AB-"), F.col("n"), F.lit(" c")), en).alias("id"),
        entities.canonical(F.lit("name"), F.concat(F.lit("Room "), "w", F.lit("!")), en).alias("name"),
    )


#: what customers' calls say, as three lanes heard it: as it is; amounts off by one in every other line; ids left out, and a word put into dates
_CALLS = "select c_custkey as k, 1 + c_custkey % 7 as day, c_custkey * 3 + 11 as item, c_nationkey as lots, 1 + c_custkey % 50 as amount from {customer}"
_ORDER = """concat('call me at ', {amount}, ' on may ', {inside}, day, ' about ref', {id}, ' and ', 3000 + lots, ' lots')"""
_PLAIN = {"amount": "concat('$', 100 + amount)", "inside": "''", "id": "concat(' x', item, 'y')"}
_LANES = {"a": _PLAIN, "b": _PLAIN | {"amount": "concat('$', 100 + amount + case when day % 2 = 0 then 1 else 0 end)"}, "c": _PLAIN | {"inside": "case when day % 3 = 1 then 'um ' else '' end", "id": "case when k % 3 = 0 then '' else concat(' x', item, 'y') end"}}
_MARKS = {"currency": "[cast(100 + amount as varchar), 'dollars']", "date": "['may', cast(day as varchar)]", "id": "[concat('x', item, 'y')]", "number": "[cast(3000 + lots as varchar)]"}
ORDERS = " union all ".join(f"select '{lane}' as provider, k, day, item, lots, amount, {_ORDER.format(**said)} as text, {_ORDER.format(**_PLAIN)} as reference from ({_CALLS.format(customer='customer')}) as t" for lane, said in _LANES.items())
#: tokens of a reference are all different here, so a token that isn't heard is an error of its class: a deletion if fewer words were heard than said
SCORED = f"""with o as ({ORDERS}), h as (select *, string_split(regexp_replace(text, '[$]([0-9]+)', '\\1 dollars'), ' ') as w from o where k % 5 <> 0),
  c as ({" union all ".join(f"select provider, '{c}' as class, w, {m} as m, k, day from h" for c, m in _MARKS.items())}),
  e as (select provider, class, k, day, len(list_filter(m, lambda x: not list_contains(w, x))) as gone, len(m) as tokens, case when len(m) = 2 and list_contains(w, m[1]) and list_contains(w, m[2]) then list_position(w, m[2]) - list_position(w, m[1]) - 1 else 0 end as put_in from c)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.sql(_CALLS, customer=table(spark, sf_dir, "customer"))
    lane = [F.struct(F.lit(k).alias("provider"), F.expr(_ORDER.format(**v)).alias("text")) for k, v in _LANES.items()]
    rows = said.select("*", F.expr(_ORDER.format(**_PLAIN)).alias("reference"), F.explode(F.array(*lane)).alias("x")).select("*", "x.*").drop("x")
    return rows.select("*", F.lit("stream").alias("mode"), F.lit("en-US").alias("language"), F.lit(None).cast("string").alias("annotated"), F.expr("case when k % 5 = 0 then 'failed' end").alias("error"))


@query(
    f"""{SCORED} select provider, 'stream' as mode, 'en-US' as language, class, count(*) as occurrences, count(*) filter (where gone = 0 and put_in = 0) as exact, cast(coalesce(sum(gone) filter (where class <> 'id'), 0) as bigint) as substitutions, cast(coalesce(sum(gone) filter (where class = 'id'), 0) as bigint) as deletions,
  cast(sum(put_in) as bigint) as insertions, cast(sum(tokens) as bigint) as tokens, round(sum(gone + put_in) / sum(tokens), 6) as error_rate, round(count(*) filter (where gone = 0 and put_in = 0) / count(*), 6) as exact_rate from e group by provider, class"""
)
def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From references without tags to scores by lane and class: tagged by rule, aligned with what was heard, errors counted within the tags."""
    return rounded(scores.by_class(scores.with_scores(orders(spark, sf_dir))))


@query(f"{SCORED}, f as (select provider, k, day, bool_or(gone > 0 or put_in > 0) as damaged from e group by all) select provider, damaged, count(*) as clips from f group by all union all select provider, null, count(*) from o where k % 5 = 0 group by provider")
def entity_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a clip's entities came through, by lane; null for clips that failed."""
    told = scores.with_scores(orders(spark, sf_dir))
    return told.groupBy("provider", scores.damaged(F.col("entities")).alias("damaged")).agg(F.count("*").alias("clips"))


@query(
    f"""{SCORED}, t as (select provider, class, sum(gone + put_in) / sum(tokens) as err, count(*) filter (where gone = 0 and put_in = 0) / count(*) as exact from e group by all)
  select provider, 'stream' as mode, 'en-US' as language, {", ".join(f"round(max({k}) filter (where class = '{c}'), 6) as \"ent_{k}[{c}]\"" for c in _MARKS for k in ("err", "exact"))} from t group by provider"""
)
def entity_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores as columns of a lane's row, one for each class that the data has."""
    return scores.wide(scores.by_class(scores.with_scores(orders(spark, sf_dir)))).select("provider", "mode", "language", *[F.round(F.col(f"`ent_{k}[{c}]`"), 6).alias(f"ent_{k}[{c}]") for c in _MARKS for k in ("err", "exact")])
