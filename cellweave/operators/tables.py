"""Web tables: mention jobs, sections, serialised context and its windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.text import blank_if_null, clean_text, collapse, let, page_title, question_column, question_mention, short_marker, strip


def cell(matrix: Column, row: Column, col: Column) -> Column:
    """A cell of a ragged matrix, empty out of range."""
    return blank_if_null(F.get(F.get(matrix, row), col))


def text_matrix(text: Column, cells: Column, header: Column) -> Column:
    """text if it has rows, else the header over cells cut to its width; rows that are no lists are dropped."""
    fit = F.transform(F.filter(cells, lambda r: r.isNotNull()), lambda r: F.slice(r, 1, F.size(header)))
    return F.when(F.size(F.coalesce(text, F.array())) > 0, F.filter(text, lambda r: r.isNotNull())).otherwise(F.concat(F.array(header), fit))


def mention_jobs(tables: DataFrame) -> DataFrame:
    """One row per linked cell of tables (source_file, text, link, entity, caption, and what else they carry)."""
    others = [c for c in tables.columns if c not in ("text", "link", "entity")]
    # Each row takes its own cells, links and entities along, and each cell its own three strings.
    matrix = F.arrays_zip(F.col("text").alias("t"), F.col("link").alias("l"), F.col("entity").alias("e"))
    kept = F.slice(F.transform(matrix, lambda r, i: F.struct(i.alias("i"), r["t"].alias("t"), r["l"].alias("l"), r["e"].alias("e"))), 2, F.greatest(F.size("text") - 1, F.lit(0)))
    rows = tables.select(*others, F.get("text", F.lit(0)).alias("__header"), F.explode(kept).alias("__r"))
    fit = lambda c: F.slice(F.coalesce(F.col(f"__r.{c}"), F.array().cast("array<string>")), 1, F.size("__header"))
    cells = rows.select(*others, "__header", F.col("__r.i").alias("row_index"), F.posexplode(F.arrays_zip(fit("t").alias("t"), fit("l").alias("l"), fit("e").alias("e"))).alias("col_index", "__c"))
    out = cells.select(
        F.concat_ws("", F.col("source_file"), F.lit("#"), F.col("row_index"), F.lit(":"), F.col("col_index")).alias("job_id"), *others, "row_index", "col_index",
        clean_text(F.col("__c.t")).alias("mention"), clean_text(F.get("__header", F.col("col_index"))).alias("column_name"), clean_text(F.col("__c.e")).alias("gold_qid"), clean_text(F.col("__c.l")).alias("gold_wiki_title"),
    )
    out = out.where((F.col("mention") != "") & ((F.col("gold_qid") != "") | (F.col("gold_wiki_title") != "")))
    if "caption" in others:
        caption = clean_text(F.col("caption"))
        out = out.withColumn("caption", F.when(F.lower(caption) == "none", "").otherwise(caption))
    return out


def section_of(context: Column, mention: Column, link_title: Column) -> Column:
    """The section whose text fits a mention best: 2 for the mention, 3 for the link's title, 0.2 for a table; the
    first of the best, empty if none scores."""
    blank = F.lit("null")
    entries = F.filter(F.map_entries(context), lambda e: (e["key"] != blank) & (strip(e["key"]) != ""))

    def score(e: Column) -> Column:
        low = F.lower(blank_if_null(e["value"]))
        title = F.lower(F.replace(link_title, F.lit("_"), F.lit(" ")))
        return (
            F.when((mention != "") & F.contains(low, F.lower(mention)), 2.0).otherwise(0.0)
            + F.when((title != "") & F.contains(low, title), 3.0).otherwise(0.0) + F.when(F.contains(low, F.lit("{|")), 0.2).otherwise(0.0)
        )

    ranked = F.array_sort(F.transform(entries, lambda e, i: F.struct((-score(e)).alias("s"), i.alias("i"), e["key"].alias("k"))))
    best = F.get(ranked, F.lit(0))
    return F.when(best["s"] < 0, best["k"]).otherwise("")


def page_of(context: Column) -> Column:
    return page_title(blank_if_null(F.element_at(context, F.lit("null"))))


def input_seg(page: Column, section: Column, caption: Column, header: Column, rows: Column) -> Column:
    """Serialise a table: [TLE] page, section, caption; [TAB] header; rows cut or padded to the header's width."""
    width = F.size(header)
    line = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: clean_text(F.get(r, i))), " | ")
    body = F.transform(rows, lambda r, i: F.concat(F.lit("row "), (i + 1).cast("string"), F.lit(": | "), line(r), F.lit(" |")))
    return F.concat(
        F.lit("[TLE] The Wikipedia page is about "), page, F.lit(". The Wikipedia section is about "), section, F.lit("."),
        F.when(caption != "", F.concat(F.lit(" The table caption is about "), caption, F.lit("."))).otherwise(""),
        F.lit(" [TAB] col: | "), line(header), F.lit(" | "), F.array_join(body, " [SEP] "),
    )


def seg_prefix(seg: Column) -> Column:
    return F.regexp_extract(seg, r"(?is)^(.*?)\brow\s+\d+\s*:", 1)


def seg_header(seg: Column) -> Column:
    """Header cells without blanks."""
    inner = F.regexp_extract(seg_prefix(seg), r"(?is)\[TAB\].*?col:\s*\|(.*)$", 1)
    return F.filter(F.transform(F.split(inner, r"\|"), strip), lambda c: c != "")


def seg_rows(seg: Column) -> Column:
    """array<struct<number, cells, text>>; blank cells are left out, so later cells move up."""
    body = F.regexp_extract(seg, r"(?is)^.*?(\brow\s+\d+\s*:.*)$", 1)
    parts = F.filter(F.transform(F.split(body, r"(?i)\[SEP\]"), strip), lambda p: p.rlike(r"(?i)^row\s+\d+\s*:"))
    cells = lambda p: F.filter(F.transform(F.split(F.regexp_extract(p, r"(?is)^row\s+\d+\s*:(.*)$", 1), r"\|"), strip), lambda c: c != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(?i)^row\s+(\d+)", 1).cast("int").alias("number"), cells(p).alias("cells"), p.alias("text")))


def row_cells(row: Column, mode: str = "bars") -> Column:
    """Cells of one row's text. "bars" leaves blank ones out and takes a row without bars as one cell; "strict" has none
    for such a row; "blanks" keeps blank cells between the outer bars."""
    body = F.regexp_extract(row, r"(?is)^\s*row\s+\d+\s*:(.*)$", 1)
    if mode == "strict":
        inner = F.regexp_extract(row, r"(?s)^[^|]*\|(.*)$", 1)
        return F.filter(F.transform(F.split(inner, r"\|"), strip), lambda c: c != "")
    parts = F.transform(F.split(F.when(body == "", row).otherwise(body), r"\|"), strip)
    filled = F.filter(parts, lambda c: c != "")
    if mode == "blanks":
        return F.when(F.size(parts) >= 2, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(filled)
    return filled


def row_number_of(row: Column) -> Column:
    """The number of a row's text whose prefix is just "row N", else null."""
    return F.regexp_extract(row, r"(?i)^\s*row\s+(\d+)\s*:", 1).try_cast("int")


def find_entity(seg: Column, mention: Column, column_name: Column) -> Column:
    """struct(row, col) from 0: the column by header name, and the first row whose cell there contains the mention;
    null if there is none."""
    col = F.array_position(F.transform(seg_header(seg), F.lower), F.lower(column_name)).cast("int") - 1

    def place(at: Column) -> Column:
        holds = F.transform(seg_rows(seg), lambda r: F.contains(F.lower(F.coalesce(F.get(r["cells"], at), F.lit(""))), F.lower(mention)))
        return F.struct((F.array_position(holds, F.lit(True)).cast("int") - 1).alias("row"), at.alias("col"))

    found = let(col, place)
    return F.when((mention != "") & (found["col"] >= 0) & (found["row"] >= 0), found)


def shifted_window(rows: Column, at: Column, size: int = 10, before: int = 4) -> Column:
    """`size` rows round position `at`, moved to stay inside; all rows if there are no more than size."""
    n = F.size(rows)
    start = F.greatest(F.lit(0), F.least(at - before, n - size))
    return F.when(n <= size, rows).otherwise(F.slice(rows, start + 1, size))


def mention_window(rows: Column, at: Column, cell: Column, mention: Column) -> Column:
    """The clipped window if there are more than ten rows and the cell is the mention itself, else all rows."""
    return F.when((F.size(rows) > 10) & (cell == mention), clipped_window(rows, at)).otherwise(rows)


def fallback_row(at: Column, number: Column, n: Column) -> Column:
    """A row's position: as found, else from its number, moved into the table."""
    return F.coalesce(at, F.least(F.greatest(F.lit(0), number - 1), n - 1))


def context_rows(rows: Column, at: Column, most: Column) -> Column:
    """`most` rows round position `at`, half before it, moved to stay inside; all rows if most is negative or enough."""
    half = F.floor(most / 2).cast("int")
    start = F.greatest(F.lit(0), F.least(at - half, F.size(rows) - most))
    return F.when((most < 0) | (F.size(rows) <= most), rows).otherwise(F.slice(rows, start + 1, most))


def clipped_window(rows: Column, at: Column, before: int = 4, after: int = 6) -> Column:
    """Rows [at - before, at + after), not moved at the edges."""
    start = F.greatest(F.lit(0), at - before)
    return F.slice(rows, start + 1, at + after - start)


def simplify(seg: Column, at: Column) -> Column:
    """Keep a window of rows; the entity's row stays as it is, others keep the entity's column only."""
    def lines(rows: Column) -> Column:
        def short(a: Column) -> Column:
            line = lambda r: F.when((r["number"] == F.get(rows, a["row"])["number"]) | (F.size(r["cells"]) <= a["col"]), r["text"]).otherwise(F.concat(F.lit("row "), r["number"].cast("string"), F.lit(": "), F.get(r["cells"], a["col"])))
            return F.transform(shifted_window(rows, a["row"]), line)

        return let(at, short)

    return F.when(at.isNotNull(), collapse(F.concat(seg_prefix(seg), F.array_join(let(seg_rows(seg), lines), " [SEP] "))))


def aligned(df: DataFrame) -> DataFrame:
    """Samples (input_seg, question, output) as they are evaluated: the table cut round the entity where that is found,
    the short marker in question and output."""
    at = find_entity(F.col("input_seg"), question_mention(F.col("question")), question_column(F.col("question")))
    out = df.withColumn("__at", at).withColumn("input_seg", F.coalesce(simplify(F.col("input_seg"), F.col("__at")), F.col("input_seg"))).drop("__at")
    return out.withColumn("question", short_marker(F.col("question"))).withColumn("output", short_marker(F.col("output")))


def find_numbered(seg: Column, q: Column) -> Column:
    """struct(row, col, surface) for a question that names its column "col N": the first row with the mention in cell N,
    blank cells counted; null if there is none."""
    quotes = r"^['\"]+|['\"]+$"
    mention = F.regexp_replace(collapse(F.regexp_extract(q, r"(?is)selected entity mention in the table cell is:\s*['\"]?(.*?)['\"]?\.\s*The column name", 1)), quotes, "")
    number = F.regexp_extract(strip(F.regexp_extract(q, r"(?is)The column name for .*? is\s*([^.]+)\.", 1)), r"(?i)^col\s*(\d+)$", 1)

    def cells(body: Column) -> Column:
        parts = F.transform(F.split(body, r"\|"), strip)
        return F.when(F.size(parts) >= 2, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.filter(parts, lambda c: c != ""))

    def rows(m: Column) -> Column:
        parts = F.filter(F.split(seg, r"\[SEP\]"), lambda p: p.rlike(r"(?is)row\s+\d+\s*:"))
        row = r"(?is)row\s+(\d+)\s*:\s*(.*)$"
        return F.filter(F.transform(parts, lambda p: F.struct((F.regexp_extract(strip(p), row, 1).cast("int") - 1).alias("row"), F.get(cells(F.regexp_extract(strip(p), row, 2)), number.cast("int")).alias("cell"))), lambda r: F.contains(F.lower(collapse(r["cell"])), F.lower(m)))

    found = let(mention, lambda m: let(F.get(rows(m), F.lit(0)), lambda r: F.when(r.isNotNull() & (m != ""), F.struct(r["row"].alias("row"), number.cast("int").alias("col"), m.alias("surface")))))
    return F.when(number != "", found)


def adapted(df: DataFrame) -> DataFrame:
    """Records that carry `input` instead of input_seg, and no entity: both filled in where they can be."""
    seg = F.coalesce(F.col("input_seg"), F.col("input")) if "input_seg" in df.columns else F.col("input")
    out = df.withColumn("input_seg", F.coalesce(seg, F.lit("")))
    inferred = find_numbered(F.col("input_seg"), F.coalesce("question", F.lit("")))
    return out.withColumn("entity", F.coalesce(F.col("entity"), inferred) if "entity" in df.columns else inferred)
