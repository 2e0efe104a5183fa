"""Sources and their checks: S1 to S6, with files written by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import load, register
from undertow.operators.ingest import repair
from undertow.session import new_path
from undertow.sources.readers import read_table
from undertow.sources.sniff import file_format
from undertow.sources.validate import is_binary

ORDER_TOTALS = """SELECT o_orderstatus AS status, count(*) AS orders,
round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_key,
CAST(min(o_orderdate) AS VARCHAR) AS first_day FROM orders GROUP BY o_orderstatus"""


def order_text(spark, folder):
    """Orders as they look in a file: money with a sign, days as text."""
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("Order Key"),
        F.col("o_orderstatus").alias("Status"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Day"),
    )


def order_totals(table):
    return table.groupBy(F.col("Status").alias("status")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.round(F.sum("Total"), 2).alias("total"),
        F.max("Order Key").cast("bigint").alias("last_key"),
        F.min("Day").cast("string").alias("first_day"),
    )


def back(spark, path, kind=None):
    loaded = read_table(spark, path, kind)
    return order_totals(repair(loaded.table, loaded.log).table)


def one_file_a_row(texts, path):
    """Each row becomes a file. All lie in one folder, which a reader lists at once, and tasks put
    theirs there themselves, so the driver moves none."""
    committed = texts.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    committed.option("maxRecordsPerFile", 1).text(path)


@register("read_csv", ORDER_TOTALS)
def read_csv(spark, folder):
    path = new_path(spark, "csv")
    order_text(spark, folder).write.option("header", True).csv(path)
    return back(spark, path)


@register("read_tsv", ORDER_TOTALS)
def read_tsv(spark, folder):
    path = new_path(spark, "tsv")
    order_text(spark, folder).write.option("header", True).option("sep", "\t").csv(path)
    return back(spark, path, "tsv")


@register("read_txt", ORDER_TOTALS)
def read_txt(spark, folder):
    """The separator is found in the first lines: there are commas too, but fewer."""
    path = new_path(spark, "txt")
    order_text(spark, folder).write.option("header", True).option("sep", "|").csv(path)
    return back(spark, path, "txt")


@register("read_csv_with_title_rows", ORDER_TOTALS)
def read_csv_with_title_rows(spark, folder):
    """Files of a thousand orders, each under two title rows and the real header."""
    cells = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in ("Order Key", "Status", "Total", "Day")]
    lines = order_text(spark, folder).select(
        F.floor(F.col("Order Key").cast("bigint") / 1000).alias("file"),
        F.concat_ws(",", *cells).alias("line"),
    )
    titles = F.array(F.lit("Order export,,,"), F.lit(",,,"), F.lit("Order Key,Status,Total,Day"))
    files = lines.groupBy("file").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    path = new_path(spark, "titled")
    text = F.array_join(F.concat(titles, "lines"), "\n")
    one_file_a_row(files.select(text.alias("value")), path)
    return back(spark, path, "csv")


@register("read_csv_latin1", ORDER_TOTALS)
def read_csv_latin1(spark, folder):
    """One column holds bytes that are no UTF-8; the reader falls back to Latin-1."""
    path = new_path(spark, "latin1")
    table = order_text(spark, folder).withColumn("Note", F.lit("café"))
    table.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    loaded = read_table(spark, path, "csv")
    fixed = repair(loaded.table).table
    return order_totals(fixed.where(F.col("Note") == "café"))


LABEL_COUNTS = """SELECT quality, toxic, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS ids
FROM labels GROUP BY quality, toxic"""


def label_counts(table):
    return table.groupBy(
        F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")
    ).agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_id").cast("bigint").alias("ids"))


def label_files(spark, folder, document):
    """One JSON document per thousand labels."""
    chunk = F.floor(F.col("doc_id") / 1000).alias("chunk")
    cells = F.struct("doc_id", "quality", "toxic")
    files = load(spark, folder, "labels").groupBy(chunk).agg(F.collect_list(cells).alias("rows"))
    path = new_path(spark, "json")
    files.select(document.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return read_table(spark, path, "json").table


@register("read_json_records", LABEL_COUNTS)
def read_json_records(spark, folder):
    return label_counts(label_files(spark, folder, F.to_json("rows")))


@register("read_json_columns_and_data", LABEL_COUNTS)
def read_json_columns_and_data(spark, folder):
    names = F.array(F.lit("doc_id"), F.lit("quality"), F.lit("toxic"))
    data = F.transform("rows", lambda r: F.array(r["doc_id"], r["quality"], r["toxic"]))
    document = F.to_json(F.struct(names.alias("columns"), data.alias("data")))
    return label_counts(label_files(spark, folder, document))


@register("read_json_lists", LABEL_COUNTS)
def read_json_lists(spark, folder):
    lists = [F.col(f"rows.{n}").alias(n) for n in ("doc_id", "quality", "toxic")]
    return label_counts(label_files(spark, folder, F.to_json(F.struct(*lists))))


@register(
    "read_parquet",
    """SELECT event_type, count(*) AS events, round(sum(value), 2) AS total
    FROM events GROUP BY event_type""",
)
def read_parquet(spark, folder):
    """The format is found from the first bytes; the row identity comes with the scan."""
    table = read_table(spark, f"{folder}/events.parquet", row_id="row_id").table
    return table.groupBy("event_type").agg(
        F.count_distinct("row_id").alias("events"), F.round(F.sum("value"), 2).alias("total")
    )


UPLOADS = """SELECT url AS name, html AS content FROM pages
UNION ALL
SELECT concat(url, CASE page_id % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.dat' WHEN 2 THEN '.parquet'
  ELSE '' END), html FROM pages
UNION ALL
SELECT concat('upload/', source, CASE doc_id % 3 WHEN 0 THEN '.tsv' WHEN 1 THEN '' ELSE '.v2' END),
  CASE doc_id % 5 WHEN 0 THEN concat('PAR1', text) WHEN 1 THEN concat('  [', text)
  WHEN 2 THEN concat('PK', chr(3), chr(4), text) ELSE text END FROM documents
"""
EXTENSION = "lower(regexp_extract(name, '[^/]\\.([^./]+)$', 1))"


@register(
    "file_formats",
    f"""SELECT format, count(*) AS files FROM (SELECT CASE
      WHEN left(content, 4) = concat('PK', chr(3), chr(4)) THEN 'xlsx'
      WHEN left(content, 4) = 'PAR1' THEN 'parquet'
      WHEN {EXTENSION} IN ('csv', 'tsv', 'txt', 'xlsx', 'xls', 'json', 'parquet') THEN {EXTENSION}
      WHEN ltrim(content, concat(' ', chr(9), chr(10), chr(13)))[1] IN ('{{', '[') THEN 'json'
      WHEN {EXTENSION} <> '' THEN {EXTENSION} ELSE 'csv' END AS format
    FROM ({UPLOADS})) GROUP BY format""",
)
def file_formats(spark, folder):
    """Pages and documents as uploads under true, wrong and missing extensions."""
    tables = {t: load(spark, folder, t) for t in ("pages", "documents")}
    sql = UPLOADS
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    uploads = spark.sql(sql, **tables)
    found = file_format(F.col("name"), F.encode("content", "UTF-8"))
    return uploads.groupBy(found.alias("format")).agg(F.count(F.lit(1)).alias("files"))


CELLS = """SELECT 'documents' AS origin, CASE doc_id % 6 WHEN 0 THEN concat(text, chr(7))
  WHEN 1 THEN concat(chr(1), chr(2), chr(3), chr(4), left(text, 9)) ELSE text END AS cell
FROM documents
UNION ALL
SELECT 'pages' AS origin, html AS cell FROM pages
"""
CONTROL = "(length(cell) - length(regexp_replace(cell, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')))"


@register(
    "binary_cells",
    f"""SELECT origin, count(*) AS cells, count(*) FILTER (WHERE {CONTROL} >
    greatest(3.0::DOUBLE, length(cell) * 0.25::DOUBLE)) AS binary_cells
    FROM ({CELLS}) GROUP BY origin""",
)
def binary_cells(spark, folder):
    tables = {t: load(spark, folder, t) for t in ("pages", "documents")}
    sql = CELLS
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **tables).groupBy("origin").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(is_binary(F.col("cell"))).alias("binary_cells"),
    )


@register(
    "read_csv_long_lines",
    """SELECT count(*) FILTER (WHERE o_orderkey % 97 <> 0) AS kept,
    count(*) FILTER (WHERE o_orderkey % 97 = 0) AS left_out FROM orders""",
)
def read_csv_long_lines(spark, folder):
    """Lines with more fields than the header are left out wherever they stand, and counted."""
    lines = load(spark, folder, "orders").select(
        F.floor(F.col("o_orderkey") / 1000).alias("file"),
        F.concat_ws(
            ",", F.col("o_orderkey"), "o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "stray")
        ).alias("line"),
    )
    files = lines.groupBy("file").agg(F.collect_list("line").alias("lines"))
    path = new_path(spark, "long-lines")
    text = F.array_join(F.concat(F.array(F.lit("Order Key,Status")), "lines"), "\n")
    one_file_a_row(files.select(text.alias("text")), path)
    loaded = read_table(spark, path, "csv")
    counted = sum(int(detail.split()[0]) for _, step, _, detail in loaded.log if step == "long lines")
    return loaded.table.agg(F.count("Order Key").alias("kept")).withColumn(
        "left_out", F.lit(counted).cast("bigint")
    )


@register("read_csv_mixed_files", ORDER_TOTALS)
def read_csv_mixed_files(spark, folder):
    """Every second file has title rows, and every third another order of columns."""
    orders = order_text(spark, folder).withColumn("file", F.floor(F.col("Order Key").cast("bigint") / 1000))
    plain, turned = ("Order Key", "Status", "Total", "Day"), ("Day", "Total", "Status", "Order Key")

    def line(names):
        return F.concat_ws(",", *[F.concat(F.lit('"'), F.col(n), F.lit('"')) for n in names])

    other = F.col("file") % 3 == 0
    lines = orders.select("file", F.when(other, line(turned)).otherwise(line(plain)).alias("line"))
    files = lines.groupBy("file").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    header = F.when(other, ",".join(turned)).otherwise(",".join(plain))
    top = F.when(F.col("file") % 2 == 0, F.array(F.lit("Order export,,,"), F.lit(",,,"))).otherwise(F.array())
    path = new_path(spark, "mixed")
    text = F.array_join(F.concat(top, F.array(header), "lines"), "\n")
    one_file_a_row(files.select(text.alias("text")), path)
    loaded = read_table(spark, path, "csv")
    return order_totals(repair(loaded.table.select(*plain), loaded.log).table)


@register(
    "read_csv_quoted_blocks",
    """SELECT lang, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS ids,
    CAST(sum(length(text)) AS BIGINT) AS chars,
    CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS breaks
    FROM documents GROUP BY lang""",
)
def read_csv_quoted_blocks(spark, folder):
    """Texts of many lines in quoted cells: the blocks of each file are parsed side by side."""
    docs = load(spark, folder, "documents").select("doc_id", "lang", F.col("text").alias("body"))
    path = new_path(spark, "quoted")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    table = read_table(spark, path, "csv").table
    return table.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.col("doc_id").cast("bigint")).alias("ids"),
        F.coalesce(F.sum(F.length("body")), F.lit(0)).cast("bigint").alias("chars"),
        F.sum(F.coalesce(F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))), F.lit(0)))
        .cast("bigint").alias("breaks"),
    )


def order_files(spark, folder, header, line, ending="csv"):
    """Files of a thousand orders, each with a header and lines that may depend on its number."""
    orders = order_text(spark, folder).withColumn("file", F.floor(F.col("Order Key").cast("bigint") / 1000))
    files = orders.groupBy("file", header.alias("header")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    path = new_path(spark, ending)
    text = F.array_join(F.concat(F.array("header"), "lines"), "\n")
    one_file_a_row(files.select(text.alias("text")), path)
    return path


@register(
    "read_csv_wider_file",
    """SELECT o_orderstatus AS status, count(*) AS orders,
    count(*) FILTER (WHERE (o_orderkey // 1000) % 2 = 1) AS with_total,
    round(sum(CASE WHEN (o_orderkey // 1000) % 2 = 1 THEN o_totalprice END), 2) AS total
    FROM orders GROUP BY o_orderstatus""",
)
def read_csv_wider_file(spark, folder):
    """Every second file has two more columns; the others get NULL there, and no row is lost."""
    wide = F.col("file") % 2 == 1
    cells = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in ("Total", "Order Key", "Status", "Day")]
    header = F.when(wide, "Total,Order Key,Status,Day").otherwise("Order Key,Status")
    line = F.when(wide, F.concat_ws(",", *cells)).otherwise(F.concat_ws(",", *cells[1:3]))
    loaded = read_table(spark, order_files(spark, folder, header, line), "csv")
    money = F.regexp_replace("Total", "[$,]", "").cast("double")
    return loaded.table.groupBy(F.col("Status").alias("status")).agg(
        F.count(F.lit(1)).alias("orders"), F.count("Total").alias("with_total"),
        F.round(F.sum(money), 2).alias("total"),
    )


@register("read_txt_mixed_separators", ORDER_TOTALS)
def read_txt_mixed_separators(spark, folder):
    """Each file of a folder has the separator that its own first lines show."""
    names = ("Order Key", "Status", "Total", "Day")
    which = (F.col("file") % 4).cast("int")

    def by_file(make):
        return F.element_at(F.array(*[make(s) for s in ("\t", "|", ";", ",")]), which + 1)

    header = by_file(lambda s: F.lit(s.join(names)))
    line = by_file(lambda s: F.concat_ws(s, *[F.concat(F.lit('"'), F.col(n), F.lit('"')) for n in names]))
    loaded = read_table(spark, order_files(spark, folder, header, line, "txt"), "txt")
    return order_totals(repair(loaded.table, loaded.log).table)
