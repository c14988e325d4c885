"""Queries of readers and writers: tables are written in a format and read back by its reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.registry import Tables, query
from quern.schema import resolve_columns
from quern.session import scratch
from quern.sources import readers, sinks
from quern.streaming import windows


#: Lines of a text file; a longer text is written as several files, each with the head and the tail.
LINES_A_FILE = 500_000


def text_file(t: Tables, name: str, *parts: DataFrame | list[str], compression: str = "none", size: int | None = None) -> str:
    """A folder of text files of the parts one after another, each (place, line) in the order of place.

    Lists of lines before the first table are the head of every file, those after it the tail.
    Lines go to files by ranges, so no task writes more than one file; size is the number of
    lines, if it is known.
    """
    path, rows = scratch(t.spark, name), None
    tables = [p for p in parts if not isinstance(p, list)]
    first = next(i for i, p in enumerate(parts) if not isinstance(p, list))
    head, tail = ([x for p in some if isinstance(p, list) for x in p] for some in (parts[:first], parts[first:]))
    for i, p in enumerate(tables):
        part = p.select(F.lit(i).alias("part"), F.col("place").cast("long").alias("place"), F.col("line").cast("string").alias("line"))
        rows = part if rows is None else rows.union(part)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        framing = lambda x: pa.record_batch({"line": x if isinstance(x, pa.Array) else pa.array(x, pa.string())})
        yield framing(head)
        for b in batches:
            yield framing(b.column(0))
        yield framing(tail)

    files = 1 + (sum(p.count() for p in tables) if size is None else size) // LINES_A_FILE
    dealt = rows.repartitionByRange(int(files), "part", "place").sortWithinPartitions("part", "place").select("line")
    (dealt.mapInArrow(framed, "line string") if head or tail else dealt).write.text(path, compression=compression)
    return path


def lines(*texts: str) -> list[str]:
    return list(texts)


def body(df: DataFrame, place: str, *columns: Column | str, sep: str = "\t") -> DataFrame:
    return df.select(F.col(place).alias("place"), F.concat_ws(sep, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("line"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_round_trip(t: Tables):
    path = scratch(t.spark, "csv")
    sinks.to_csv(t.part.select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return readers.delimited(t.spark, path, schema="p_partkey long, p_name string, p_size int, p_retailprice double")


@query("SELECT 'ISO-8859-1' AS encoding, s_suppkey, 'é ' || s_name AS name FROM supplier")
def sniffed_table(t: Tables):
    path = scratch(t.spark, "latin")
    t.supplier.select("s_suppkey", F.concat(F.lit("é "), "s_name").alias("name")).write.option("encoding", "ISO-8859-1").csv(path, sep="\t", header=True)
    encoding, sep = readers.sniff(t.spark, path, ("UTF-8", "ISO-8859-1"))
    return readers.delimited(t.spark, path, sep=sep, encoding=encoding).select(F.lit(encoding).alias("encoding"), F.col("s_suppkey").cast("long").alias("s_suppkey"), "name")


@query("SELECT p_partkey::VARCHAR AS gene, 'size' AS sample, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey::VARCHAR, 'price', p_retailprice FROM part")
def gzip_counts(t: Tables):
    path = text_file(t, "counts", lines("gene\tsize\tprice"), body(t.part, "p_partkey", "p_partkey", "p_size", "p_retailprice"), compression="gzip")
    return readers.expression_long(readers.delimited(t.spark, path, sep="\t"), "gene")


@query("SELECT c_custkey::VARCHAR AS id, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey::VARCHAR, NULL, s_name FROM supplier")
def united_files(t: Tables):
    a, b = scratch(t.spark, "a"), scratch(t.spark, "b")
    sinks.to_csv(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), a)
    sinks.to_csv(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), b)
    return readers.union_files(t.spark, [a, b])


@query("SELECT DISTINCT p_name AS gene FROM part")
def gene_list(t: Tables):
    path = text_file(t, "genes", lines("gene_symbol", ""), t.part.select(F.col("p_partkey").alias("place"), F.concat(F.lit("  "), "p_name").alias("line")))
    return readers.name_list(t.spark, readers.first_existing(t.spark, [path + "-absent", path]))


@query("SELECT p_brand AS set, 'http://' || p_brand AS description, 'X' AS source, upper(p_name) AS gene FROM part GROUP BY ALL")
def gene_sets(t: Tables):
    sets = t.part.groupBy("p_brand").agg(F.concat_ws("\t", F.collect_list("p_name")).alias("names"))
    path = text_file(t, "gmt", sets.select(F.lit(0).alias("place"), F.concat_ws("\t", "p_brand", F.concat(F.lit("http://"), "p_brand"), "names").alias("line")))
    return readers.gmt(t.spark, path, "X")


def series(t: Tables) -> str:
    head = lines('!Series_title\t"a series"', '!Sample_title\t"size"\t"price"', "!series_matrix_table_begin", '"ID_REF"\t"size"\t"price"')
    price = F.when(F.col("p_size") % 7 == 0, "null").otherwise(F.col("p_retailprice").cast("string"))
    rows = body(t.part, "p_partkey", F.concat(F.lit('"P'), "p_partkey", F.lit('"')), "p_size", price)
    return text_file(t, "series", head, rows, lines("!series_matrix_table_end"))


@query("SELECT 'P' || p_partkey AS probe, 'size' AS sample, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'P' || p_partkey, 'price', CASE WHEN p_size % 7 <> 0 THEN p_retailprice END FROM part")
def series_values(t: Tables):
    return readers.series_matrix(t.spark, series(t))


@query("SELECT 'Series_title' AS key, count(*)::VARCHAR || ' parts' AS fields FROM part UNION ALL SELECT 'Sample_title', string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) FROM part UNION ALL SELECT 'series_matrix_table_begin', '' UNION ALL SELECT 'series_matrix_table_end', ''")
def series_fields(t: Tables):
    told = t.part.agg(F.concat(F.lit('!Series_title\t"'), F.count("*"), F.lit(' parts"')).alias("a"), F.concat(F.lit('!Sample_title\t"'), F.array_join(F.sort_array(F.collect_set("p_brand")), '"\t"'), F.lit('"')).alias("b"))
    head = lines(*told.first(), "!series_matrix_table_begin")
    rows = body(t.part, "p_partkey", "p_partkey", "p_size")
    path = text_file(t, "described", head, lines("ID_REF\tsize"), rows, lines("!series_matrix_table_end"))
    return readers.series_metadata(t.spark, path).select("key", F.array_join("values", "|").alias("fields"))


@query("SELECT 'P' || p_partkey AS probe, upper(p_name) AS gene FROM part WHERE p_size % 5 <> 0")
def probe_annotation(t: Tables):
    name = F.when(F.col("p_size") % 5 == 0, F.lit("---")).when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" /// other"))).otherwise(F.col("p_name"))
    path = text_file(t, "platform", lines("#platform", "ID\tGene Symbol"), body(t.part, "p_partkey", F.concat(F.lit("P"), "p_partkey"), name))
    return readers.annotation(t.spark, path, ["ID"], ["Symbol", "Gene Symbol"])


@query("SELECT 'c' || l_suppkey AS cell, p_name AS gene, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey, p_name")
def sparse_matrix(t: Tables):
    # keys are numbered on from the least; a line's number in the name files starts at 1
    least = t.part.agg((F.min("p_partkey") - 1).alias("low")).crossJoin(t.supplier.agg((F.min("s_suppkey") - 1).alias("lows")))
    entries = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("n")).crossJoin(F.broadcast(least))
    size = t.part.agg(F.count("*").alias("a")).crossJoin(t.supplier.agg(F.count("*").alias("b"))).crossJoin(entries.agg(F.count("*").alias("n")))
    head = lines("%%MatrixMarket matrix coordinate integer general")
    sizes = lines(size.select(F.concat_ws(" ", "a", "b", "n")).first()[0])
    matrix = text_file(t, "matrix", head, sizes, body(entries, "l_partkey", F.col("l_partkey") - F.col("low"), F.col("l_suppkey") - F.col("lows"), "n", sep=" "), size=t.lineitem.count())
    genes = text_file(t, "features", body(t.part, "p_partkey", F.concat(F.lit("E"), "p_partkey"), "p_name"))
    cells = text_file(t, "barcodes", body(t.supplier, "s_suppkey", F.concat(F.lit("c"), "s_suppkey")))
    return readers.market_matrix(t.spark, matrix, genes, cells)


@query("SELECT 'rs' || p_partkey AS snp, '1' AS chr, p_size::BIGINT AS pos, 'A' AS other_allele, 'G' AS effect_allele, p_retailprice AS beta, p_size::DOUBLE AS se, CASE WHEN p_size % 2 = 0 THEN 0.01 END::DOUBLE AS p, 0.25::DOUBLE AS eaf FROM part", "beta se p eaf")
def association_vcf(t: Tables):
    even = F.col("p_size") % 2 == 0
    form, values = F.when(even, "ES:SE:LP:AF").otherwise("SE:AF:ES"), F.when(even, F.concat_ws(":", F.col("p_retailprice").cast("string"), "p_size", F.lit("2"), F.lit("0.25"))).otherwise(F.concat_ws(":", "p_size", F.lit("0.25"), F.col("p_retailprice").cast("string")))
    rows = body(t.part, "p_partkey", F.lit("1"), "p_size", F.concat(F.lit("rs"), "p_partkey"), F.lit("a"), F.lit("g"), F.lit("."), F.lit("PASS"), F.lit("."), form, values)
    return readers.gwas_vcf(t.spark, text_file(t, "vcf", lines("##fileformat=VCFv4.2", "#CHROM\tPOS"), rows))


@query("SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_discount * 10 AS w FROM lineitem WHERE l_discount * 10 >= 0.4", "w")
def scored_links(t: Tables):
    path = scratch(t.spark, "links")
    d = F.round(F.col("l_discount") * 10, 3)
    score = F.when(F.col("l_linenumber") % 2 == 0, F.round(d * 1000, 0)).otherwise(d)
    rows = t.lineitem.where("l_discount < 0.1").unionByName(t.lineitem.where("l_discount >= 0.1").withColumn("l_linenumber", F.lit(2))).select(F.concat(F.lit("s"), "l_suppkey").alias("#node1"), F.concat(F.lit(" p"), "l_partkey").alias("node2"), score.alias("combined_score"))
    rows.unionByName(rows.limit(5).withColumn("node2", F.trim(F.col("`#node1`")))).write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False)
    return readers.scored_edges(t.spark, path, {"src": ["#node1", "preferredName_A"], "dst": ["node2"], "w": ["score", "combined_score"]}).withColumn("w", F.round("w", 9)).distinct()


@query("SELECT DISTINCT 'S' || l_suppkey AS tf, 'S' || (l_partkey % 50) AS target, CASE l_returnflag WHEN 'R' THEN 'Repression' WHEN 'A' THEN 'Activation' ELSE 'Unknown' END AS mode FROM lineitem WHERE l_suppkey <> l_partkey % 50")
def regulator_links(t: Tables):
    mode = F.when(F.col("l_returnflag") == "R", "repression").when(F.col("l_returnflag") == "A", "ACTIVATION ").otherwise("?")
    rows = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("S"), F.col("l_partkey") % 50).alias("b"), mode.alias("m"), F.lit("123").alias("r")).distinct()
    path = scratch(t.spark, "regulators")
    rows.write.csv(path, sep="\t")
    return readers.regulator_edges(t.spark, path)


@query("SELECT DISTINCT 'miR-' || l_suppkey AS \"left\", 'G' || l_partkey AS \"right\" FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_partkey % 11 <> 0")
def micro_rna_targets(t: Tables):
    gene = F.when(F.col("l_partkey") % 11 == 0, "NA").otherwise(F.concat(F.lit("g"), "l_partkey"))
    rows = t.lineitem.select(F.lit("MIRT1").alias("ID"), F.concat(F.lit("miR-"), "l_suppkey").alias("miRNA"), F.when(F.col("l_linenumber") % 3 == 0, "Mus musculus").otherwise("Homo sapiens").alias("Species (Target Gene)"), gene.alias("Target Gene"))
    path = scratch(t.spark, "mirna")
    sinks.to_csv(rows, path)
    return readers.association_edges(t.spark, path, ["^mirna$", "mirna"], ["^target gene$", "^gene"], sep=",", places=(1, 3), species="homo sapiens")


@query("SELECT DISTINCT 'cg' || l_suppkey AS \"left\", 'G' || (l_partkey % 97) AS \"right\" FROM lineitem WHERE l_partkey % 97 <> 0")
def methylation_links(t: Tables):
    gene = F.when(F.col("l_partkey") % 97 == 0, "-").otherwise(F.concat(F.lit("g"), F.col("l_partkey") % 97, F.lit(";other")))
    path = scratch(t.spark, "sites")
    t.lineitem.select(F.concat(F.lit("cg"), "l_suppkey").alias("CpG"), gene.alias("Gene"), F.lit("age").alias("Trait")).write.csv(path, sep="\t", header=True)
    return readers.association_edges(t.spark, path, ["cpg", "probe"], ["gene"])


@query("SELECT 'G' || p_size AS gene, 'cg' || p_partkey AS cpg, (p_size / 50.0::DOUBLE + 0.9) / 2 AS beta, CASE WHEN (p_size / 50.0::DOUBLE + 0.9) / 2 > 0.7 THEN 'hyper' ELSE 'hypo' END AS status FROM part WHERE (p_size / 50.0::DOUBLE + 0.9) / 2 < 0.5 OR (p_size / 50.0::DOUBLE + 0.9) / 2 > 0.7", "beta")
def methylation_extremes(t: Tables):
    path = text_file(t, "beta", lines('"cpg"\t"a"\t"b"\t"c"\t"d"'), body(t.part, "p_partkey", F.concat(F.lit('"cg'), "p_partkey", F.lit('"')), F.col("p_size") / 50, F.lit("0.9"), F.lit("7"), F.lit("NA")))
    genes = t.part.select(F.concat(F.lit("cg"), "p_partkey").alias("cpg"), F.concat(F.lit("G"), "p_size").alias("gene"))
    return readers.methylation_extremes(t.spark, path, genes, 0.5, 0.7)


@query("SELECT 'c' || l_suppkey AS chemical, 'G' || l_partkey AS gene, unnest(['expression', 'binding']) AS action, unnest(['increases', 'affects']) AS degree, l_orderkey::VARCHAR AS paper FROM lineitem")
def chemical_actions(t: Tables):
    blank = [F.lit("")] * 5
    rows = body(t.lineitem, "l_orderkey", F.concat(F.lit("c"), "l_suppkey"), F.lit("D1"), F.lit(""), F.concat(F.lit("g"), "l_partkey"), *blank, F.lit("increases^expression|affects^binding"), "l_orderkey")
    return readers.interactions(t.spark, text_file(t, "ctd", lines("# comment"), rows, size=t.lineitem.count()))


@query("SELECT p_partkey::DOUBLE AS epoch, p_retailprice AS loss FROM part UNION ALL SELECT NULL, p_size FROM part WHERE p_size > 40", "epoch loss")
def log_values(t: Tables):
    a = t.part.select(F.col("p_partkey").alias("place"), F.concat(F.lit("epoch "), "p_partkey", F.lit(" loss="), F.col("p_retailprice").cast("string")).alias("line"))
    b = t.part.where("p_size > 40").select(F.col("p_partkey").alias("place"), F.concat(F.lit("best loss="), "p_size").alias("line"))
    return readers.log_metrics(t.spark, text_file(t, "log", lines("start", "warming up"), a, b), {"epoch": r"epoch (\d+)", "loss": r"loss=([\d.]+)"})


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_round_trip(t: Tables):
    path = scratch(t.spark, "json")
    sinks.to_json(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.json_records(t.spark, path, "s_suppkey long, s_name string, s_acctbal double", many_lines=False)


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def wanted_rows(t: Tables):
    path = scratch(t.spark, "large")
    sinks.to_csv(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), path)
    keys = t.part.where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return readers.in_chunks_kept(t.spark, path, keys, ["l_partkey"], schema="l_orderkey long, l_partkey long, l_quantity double")


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def file_per_key(t: Tables):
    path = scratch(t.spark, "per-key")
    sinks.per_key_csv(t.part.select("p_brand", "p_partkey", "p_size"), path, "p_brand")
    back = readers.delimited(t.spark, path)
    return back.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("total"))


@query("SELECT p_partkey, p_size FROM part")
def appended_rows(t: Tables):
    path = scratch(t.spark, "grown")
    sinks.to_parquet(t.part.where("p_size <= 30").select("p_partkey", "p_size"), path)
    for _ in range(2):  # the second time adds nothing
        sinks.append_new(t.part.where("p_size >= 20").select("p_partkey", "p_size"), path, ["p_partkey"])
    return t.spark.read.parquet(path)


@query("SELECT DISTINCT l_suppkey::VARCHAR AS a, 'sells' AS relation, l_partkey::VARCHAR AS b FROM lineitem")
def network_file(t: Tables):
    path = scratch(t.spark, "sif")
    sinks.to_sif(t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(), path, "sells")
    return readers.delimited(t.spark, path, sep="\t", header=False, schema="a string, relation string, b string")


@query("SELECT '1' AS chr, l_orderkey::BIGINT AS pos, l_returnflag AS effect_allele, l_discount AS beta, l_tax AS se, 377277::BIGINT AS n FROM lineitem")
def association_table(t: Tables):
    path = scratch(t.spark, "gwas")
    t.lineitem.select(F.lit("1").alias("#chrom"), F.col("l_orderkey").alias("pos"), F.col("l_returnflag").alias("alt"), F.col("l_discount").alias("beta"), F.col("l_tax").alias("sebeta")).write.csv(path, sep="\t", header=True, compression="gzip")
    wanted = {"chr": ["#chrom", "CHR"], "pos": ["BP"], "effect_allele": ["alt", "A1"], "beta": ["b"], "se": ["sebeta"], "n": ["N"]}
    d = resolve_columns(readers.delimited(t.spark, path, sep="\t"), wanted, {"n": 377277})
    return d.select("chr", F.col("pos").cast("long").alias("pos"), "effect_allele", F.col("beta").cast("double").alias("beta"), F.col("se").cast("double").alias("se"), F.col("n").cast("long").alias("n"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_events(t: Tables):
    return windows.first_of_each(t.events, "ts", ["user_id", "event_type"]).select("user_id", "event_type")
