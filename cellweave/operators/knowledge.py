"""Entity knowledge base from dumps: parse, assemble, upsert, alias index, type labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.text import normalize_text

ENTITY_JSON = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StructType([T.StructField("value", T.StringType())]))),
    T.StructField("descriptions", T.MapType(T.StringType(), T.StructType([T.StructField("value", T.StringType())]))),
    T.StructField("aliases", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("value", T.StringType())])))),
    T.StructField("claims", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("sitelinks", T.MapType(T.StringType(), T.StructType([T.StructField("title", T.StringType())]))),
])


def parse_triples(lines: DataFrame, value: str = "value") -> DataFrame:
    """Columns subject, predicate, object of the lines in N-Triples form; other lines go."""
    form = r"^<(.*?)> <(.*?)> (.*) \.$"
    line = F.trim(F.col(value))
    others = [c for c in lines.columns if c != value]
    return lines.where(line.rlike(form)).select(*others, *(F.regexp_extract(line, form, i).alias(n) for i, n in enumerate(("subject", "predicate", "object"), 1)))


def english_literal(obj: Column) -> Column:
    """The text of an English, plain or typed literal; empty for other languages and for links."""
    quoted = r'(?s)^"(.*)"(@[A-Za-z-]+)?(\^\^<.*>)?$'
    lang = F.regexp_extract(obj, quoted, 2)
    return F.when(obj.rlike(quoted) & lang.isin("", "@en"), unescape(F.regexp_extract(obj, quoted, 1))).otherwise("")


def unescape(x: Column) -> Column:
    """Backslash escapes of a literal, \\uXXXX and \\UXXXXXXXX included."""
    long = r"(?<!\\)\\U([0-9A-Fa-f]{8})"
    # A long escape becomes a short one, or the character itself where four digits don't hold it.
    code = lambda c: F.when(F.startswith(c, F.lit("0000")), F.concat(F.lit("\\u"), F.right(c, F.lit(4)))).otherwise(F.coalesce(F.decode(F.unhex(c), "UTF-32"), F.lit("\ufffd")))
    found = F.regexp_extract_all(x, F.lit(long), F.lit(1))
    joined = F.concat_ws("", F.flatten(F.zip_with(F.split(x, long, -1), found, lambda part, c: F.array(part, F.when(c.isNotNull(), code(c))))))
    short = F.replace(F.when(F.contains(x, F.lit("\\U")), joined).otherwise(x), F.lit("\\'"), F.lit("'"))
    # The string is read as a JSON string, whose escapes are the same.
    return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), short, F.lit('"]')), "array<string>"), F.lit(0)), short)


def assemble(triples: DataFrame, label_iri: str, description_iri: str, alias_iri: str, direct_prefix: str, type_property: str = "P31", about_iri: str = "http://schema.org/about") -> DataFrame:
    """One row per entity of triples (ord, subject, predicate, object): the first English label and description, all
    English aliases in order, the first type, popularity and statement_count."""
    qid = F.regexp_extract("subject", r"/entity/(Q\d+)$", 1)
    text = english_literal(F.col("object"))
    is_type = (F.col("predicate") == f"{direct_prefix}{type_property}") & (F.regexp_extract("object", r"/entity/(Q\d+)>$", 1) != "")
    first = lambda cond, value: F.coalesce(F.min_by(F.when(cond, value), F.when(cond, F.col("ord"))), F.lit(""))
    alias = F.when((F.col("predicate") == alias_iri) & (text != ""), F.struct("ord", text.alias("text")))
    direct = F.startswith("predicate", F.lit(direct_prefix)) & (F.col("predicate") != f"{direct_prefix}{type_property}")
    return (
        triples.where(qid != "").groupBy(qid.alias("qid"))
        .agg(
            first((F.col("predicate") == label_iri) & (text != ""), text).alias("label"),
            first((F.col("predicate") == description_iri) & (text != ""), text).alias("description"),
            first(is_type, F.regexp_extract("object", r"/entity/(Q\d+)>$", 1)).alias("p31"),
            F.transform(F.array_sort(F.collect_list(alias)), lambda a: a["text"]).alias("aliases"),
            F.count_if(F.col("predicate") == about_iri).alias("popularity"),
            (F.count_if(direct) + F.max(is_type.cast("int"))).cast("long").alias("statement_count"),
        )
    )


def parse_entities(lines: DataFrame, value: str = "value") -> DataFrame:
    """Entities of a dump with one JSON object per line, inside an array or not; lines that aren't objects go."""
    body = F.regexp_replace(F.trim(F.col(value)), r",\s*$", "")
    e = lines.withColumn("__e", F.from_json(F.when(F.startswith(body, F.lit("{")), body), ENTITY_JSON)).where(F.col("__e").isNotNull())
    english = lambda c: F.coalesce(F.col(f"__e.{c}")["en"]["value"], F.lit(""))
    first_type = F.get_json_object(F.get(F.col("__e.claims")["P31"], F.lit(0)), "$.mainsnak.datavalue.value.id")
    others = [c for c in lines.columns if c != value]
    return e.where(F.startswith(F.coalesce("__e.id", F.lit("")), F.lit("Q"))).select(
        *others, F.col("__e.id").alias("qid"), english("labels").alias("label"), english("descriptions").alias("description"),
        F.coalesce(F.transform(F.col("__e.aliases")["en"], lambda a: a["value"]), F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(first_type, F.lit("")).alias("p31"), F.coalesce(F.col("__e.sitelinks")["enwiki"]["title"], F.lit("")).alias("enwiki_title"),
        F.coalesce(F.greatest(F.size("__e.sitelinks"), F.lit(0)), F.lit(0)).cast("long").alias("popularity"),
        F.greatest(F.size("__e.claims"), F.lit(0)).cast("long").alias("statement_count"),
    )


def upsert(entities: DataFrame, key: str = "qid", order: str = "ord") -> DataFrame:
    """The last version of each entity."""
    rest = [c for c in entities.columns if c != key]
    return entities.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(key, "__last.*")


def alias_index(entities: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(alias_norm, qid, source, ord) of labels, titles and aliases that have a match form; ord is the order in which
    they are inserted. Rows of every version stay, once each."""
    rows = F.concat(
        F.array(F.struct(F.lit("label").alias("source"), F.col("label").alias("name")), F.struct(F.lit("title").alias("source"), F.col("enwiki_title").alias("name"))),
        F.transform("aliases", lambda a: F.struct(F.lit("alias").alias("source"), a.alias("name"))),
    )
    named = entities.select("qid", "ord", F.posexplode(rows).alias("nth", "at"))
    named = named.select(normalize_text(F.col("at.name"), ascii_only).alias("alias_norm"), "qid", F.col("at.source").alias("source"), "ord", "nth")
    return named.where(F.col("alias_norm") != "").groupBy("alias_norm", "qid", "source").agg(F.min(F.struct("ord", "nth")).alias("at")).select("alias_norm", "qid", "source", "at.ord", "at.nth")


def with_type_label(entities: DataFrame) -> DataFrame:
    """p31_label: the label of the entity that p31 names, empty if there is none."""
    labels = entities.where(F.col("label") != "").select(F.col("qid").alias("p31"), F.col("label").alias("p31_label"))
    return entities.join(labels, "p31", "left").withColumn("p31_label", F.coalesce("p31_label", F.lit("")))
