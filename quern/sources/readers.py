"""Readers of delimited and domain text formats. All parse in Spark's readers and column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.schema import find_column, missing_to_null, resolve_columns


def delimited(spark: SparkSession, path: str | Sequence[str], sep: str = ",", schema: str | None = None, header: bool = True, encoding: str = "UTF-8", comment: str | None = None) -> DataFrame:
    """A delimited table, compressed or not; without a schema every column is text, so no pass is spent on guessing."""
    options = {"sep": sep, "header": header, "encoding": encoding}
    if comment:
        options["comment"] = comment
    return spark.read.csv(path if isinstance(path, str) else list(path), schema=schema, **options)


def sniff(spark: SparkSession, path: str, encodings: Sequence[str] = ("UTF-8", "GBK", "ISO-8859-1"), seps: Sequence[str] = ("\t", ",", ";", "|")) -> tuple[str, str]:
    """(encoding, separator) of the first lines: the first encoding without undecodable characters, the separator that splits the header most."""
    for encoding in encodings:
        lines = [r[0] or "" for r in spark.read.option("encoding", encoding).csv(path, sep="\x01", schema="line string").limit(20).collect()]
        if not any("�" in x for x in lines):
            break
    return encoding, max(seps, key=lambda s: lines[0].count(s) if lines else 0)


def union_files(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """Files of differing columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [delimited(spark, p, **options) for p in paths])


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, in whatever store Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists")


def name_list(spark: SparkSession, path: str, column: str = "gene", headers: Sequence[str] = ("gene", "gene_symbol", "symbol")) -> DataFrame:
    """One name a line, trimmed, without blank lines and a heading; duplicates go."""
    t = F.trim("value")
    return spark.read.text(path).where((t != "") & ~F.lower(t).isin(*headers)).select(t.alias(column)).distinct()


def gmt(spark: SparkSession, path: str, source: str = "") -> DataFrame:
    """set, description, source, gene: a row a member of ragged gene-set lines."""
    f = F.split("value", "\t")
    # heads and genes are cut from a line before its genes become rows, or the line would be split again for each
    lines = spark.read.text(path).where(F.size(f) > 2).select(F.trim(f[0]).alias("set"), F.trim(f[1]).alias("description"), F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))).alias("genes"))
    rows = lines.select("set", "description", F.lit(source).alias("source"), F.explode("genes").alias("gene"))
    return rows.withColumn("gene", F.upper(F.trim("gene"))).where("gene <> ''").distinct()


def placed_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """line, file, at of text files: at orders the lines of a file.

    Large uncompressed files are read by many tasks, split at byte ranges: at is the start of the
    line's range and the line's number in its task, which two scans of the same files share.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), at.alias("at"))


def series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """probe, sample, value between the table marks of series-matrix files, in long form; missing texts are null.

    The marks and the heading are a few rows a file; the lines between them are read where they
    are, by as many tasks as the files have splits. A file without a begin mark has no rows, one
    without an end mark is read to its end.
    """
    lines = placed_lines(spark, path)
    mark = lambda x: F.min(F.when(F.trim("line") == f"!series_matrix_table_{x}", F.col("at")))
    marks = lines.where(F.startswith("line", F.lit("!"))).groupBy("file").agg(mark("begin").alias("a"), mark("end").alias("b")).where("a is not null")
    body = lines.join(marks, "file").where((F.col("at") > F.col("a")) & (F.col("b").isNull() | (F.col("at") < F.col("b"))) & (F.trim("line") != ""))
    unquoted = lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")
    heads = body.groupBy("file").agg(F.min(F.struct("at", "line")).alias("h")).select("file", F.col("h.at").alias("head_at"), F.transform(F.split("h.line", "\t"), unquoted).alias("head"))
    rows = body.join(heads, "file").where("at > head_at").withColumn("f", F.transform(F.split("line", "\t"), unquoted))
    cells = rows.select(F.col("f")[0].alias("probe"), "f", F.posexplode("head").alias("i", "sample")).where("i > 0 and sample <> ''")
    return missing_to_null(cells.select("probe", "sample", F.get("f", F.col("i")).try_cast("double").alias("value")))


def series_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key, values of the !-lines of series-matrix files; of equal keys the last."""
    rows = placed_lines(spark, path).where("line like '!%'")
    f = F.split("line", "\t")
    tidy = F.transform(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda x: F.regexp_replace(x, '^"|"$', ""))
    return rows.select("file", "at", F.ltrim(f[0], F.lit("!")).alias("key"), tidy.alias("values")).groupBy("key").agg(F.max_by("values", F.struct("file", "at")).alias("values"))


def annotation(spark: SparkSession, path: str, probe: Sequence[str], gene: Sequence[str], sep: str = "\t", comment: str = "#") -> DataFrame:
    """probe, gene of a platform table: of several symbols (A /// B) the first, in capitals; rows without one go."""
    t = resolve_columns(delimited(spark, path, sep=sep, comment=comment), {"probe": probe, "gene": gene})
    return t.select("probe", F.upper(F.trim(F.split_part("gene", F.lit("///"), F.lit(1)))).alias("gene")).where("gene is not null and gene not in ('', '---')")


def expression_long(df: DataFrame, probe: str, name: str = "sample", value: str = "value") -> DataFrame:
    """A wide matrix in long form; text that isn't a number is null."""
    samples = [c for c in df.columns if c != probe]
    return df.select(probe, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in samples]).unpivot([probe], samples, name, value)


def market_matrix(spark: SparkSession, matrix: str, genes: str, cells: str) -> DataFrame:
    """cell, gene, value of a sparse triplet file with its two name files (line numbers from 1)."""
    from quern.operators.order import place

    def numbered(path: str, c: str) -> DataFrame:
        parts = F.split("line", "\t")
        name = F.element_at(parts, -1 if c == "cell" else F.least(F.size(parts), F.lit(2)))
        return place(placed_lines(spark, path), ["file", "at"], name=f"_{c}").where("line <> ''").select(f"_{c}", name.alias(c))

    f = F.split(F.trim("value"), r"\s+")
    # the first line that isn't a comment has the sizes: as many rows, columns and entries as there are
    rows = spark.read.text(matrix).where(~F.startswith("value", F.lit("%")) & (F.size(f) == 3)).select(f[0].try_cast("long").alias("_gene"), f[1].try_cast("long").alias("_cell"), f[2].try_cast("double").alias("value"))
    g, c = numbered(genes, "gene"), numbered(cells, "cell")
    size = g.agg(F.max("_gene").alias("_n")).crossJoin(c.agg(F.max("_cell").alias("_m")))
    entries = rows.crossJoin(F.broadcast(size)).where(~((F.col("_gene") == F.col("_n")) & (F.col("_cell") == F.col("_m")) & (F.col("value") >= F.greatest("_n", "_m")) & (F.col("value") == F.floor("value")))).drop("_n", "_m")
    return entries.join(g, "_gene").join(c, "_cell").select("cell", "gene", "value")


def gwas_vcf(spark: SparkSession, path: str) -> DataFrame:
    """snp, chr, pos, other_allele, effect_allele, beta, se, p, eaf of a GWAS-VCF; tags are looked up row by row."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 10)
    tags = F.map_from_arrays(F.array_distinct(F.split(F.col("f")[8], ":")), F.slice(F.split(F.col("f")[9], ":"), F.lit(1), F.size(F.array_distinct(F.split(F.col("f")[8], ":")))))
    v = lines.where(F.size(F.split(F.col("f")[8], ":")) == F.size(F.split(F.col("f")[9], ":"))).withColumn("t", tags)
    number = lambda k: F.try_element_at("t", F.lit(k)).try_cast("double")
    return v.select(F.col("f")[2].alias("snp"), F.col("f")[0].alias("chr"), F.col("f")[1].try_cast("bigint").alias("pos"), F.upper(F.col("f")[3]).alias("other_allele"), F.upper(F.col("f")[4]).alias("effect_allele"), number("ES").alias("beta"), number("SE").alias("se"), F.pow(F.lit(10.0), -number("LP")).alias("p"), number("AF").alias("eaf"))


def scored_edges(spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, Sequence[str]], sep: str = "\t", least: float = 0.4, comment: str | None = None) -> DataFrame:
    """src, dst, w of an interaction table, aliases by columns; scores above 1 are taken as thousandths, edges below least and loops go."""
    t = resolve_columns(delimited(spark, path, sep=sep, comment=comment), columns)
    w = F.col("w").try_cast("double")
    t = t.select(F.upper(F.trim("src")).alias("src"), F.upper(F.trim("dst")).alias("dst"), F.when(w > 1, w / 1000).otherwise(w).alias("w"))
    return t.where((F.col("w") >= least) & (F.col("src") != F.col("dst")))


def regulator_edges(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """tf, target, mode (Activation, Repression or Unknown) of a headerless edge list; loops go."""
    f = delimited(spark, path, sep=sep, header=False, schema="tf string, target string, mode string, reference string")
    m = F.lower(F.trim("mode"))
    mode = F.when(m.contains("activ"), "Activation").when(m.contains("repress"), "Repression").otherwise("Unknown")
    return f.select(F.upper(F.trim("tf")).alias("tf"), F.upper(F.trim("target")).alias("target"), mode.alias("mode")).where("tf <> target")


def interactions(spark: SparkSession, path: str, gene: int = 3, actions: int = 9, papers: int = 10, sep: str = "\t") -> DataFrame:
    """chemical, gene, action, degree, paper: one row an action of a commented interaction list (degree^type parts, separated by |)."""
    f = F.split("value", sep, -1)
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.size(f) > papers)).select(f[0].alias("chemical"), F.upper(F.trim(f[gene])).alias("gene"), F.explode(F.split(f[actions], r"\|")).alias("_a"), f[papers].alias("paper"))
    return rows.select("chemical", "gene", F.element_at(F.split("_a", r"\^"), -1).alias("action"), F.element_at(F.split("_a", r"\^"), 1).alias("degree"), "paper")


def methylation_extremes(spark: SparkSession, path: str, genes: DataFrame, low: float = 0.3, high: float = 0.7, sep: str = "\t") -> DataFrame:
    """gene, cpg, beta, status of a wide matrix: mean of the values in [0, 1], kept if below low or above high, with the gene of genes (cpg, gene)."""
    f = F.split("value", sep)
    values = F.filter(F.transform(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda x: x.try_cast("double")), lambda x: x.between(0.0, 1.0))
    rows = spark.read.text(path).select(F.regexp_replace(f[0], '"', "").alias("cpg"), values.alias("v")).where(F.size("v") > 0).select("cpg", F.try_divide(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), F.size("v").cast("double")).alias("beta"))
    kept = rows.where((F.col("beta") < low) | (F.col("beta") > high))
    return kept.join(genes, "cpg").select("gene", "cpg", "beta", F.when(F.col("beta") > high, "hyper").otherwise("hypo").alias("status"))


def log_metrics(spark: SparkSession, path: str, metrics: Mapping[str, str]) -> DataFrame:
    """A row a line that has any of the metrics: each pattern's first group as a number."""
    out = spark.read.text(path).select("value", *[F.regexp_extract("value", p, 1).try_cast("double").alias(k) for k, p in metrics.items()])
    return out.where(F.coalesce(*[F.col(k) for k in metrics]).isNotNull()).drop("value")


def json_records(spark: SparkSession, path: str, schema: str | None = None, many_lines: bool = True) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=many_lines)


def in_chunks_kept(spark: SparkSession, path: str, keys: DataFrame, on: Sequence[str], **options) -> DataFrame:
    """The rows of a large delimited file whose keys are wanted: a lazy scan and a semi join, no chunks."""
    return delimited(spark, path, **options).join(keys.select(*on).distinct(), list(on), "left_semi")


def association_edges(spark: SparkSession, path: str, left: Sequence[str], right: Sequence[str], sep: str | None = None, places: tuple[int, int] = (0, 1), species: str | None = None) -> DataFrame:
    """left, right of an association list such as regulator-target or site-gene: distinct, without missing ends.

    Columns are found by patterns, else by place; of several genes (; , /) the first counts,
    in capitals. With species only rows whose species column holds that text, without case.
    """
    t = delimited(spark, path, sep=sep or sniff(spark, path)[1])
    named = [find_column(t, names, pattern=True) or t.columns[at] for names, at in zip((left, right), places, strict=True)]
    kind = find_column(t, ["species.*target", "species"], pattern=True)
    if species and kind:
        t = t.where(F.lower(f"`{kind}`").contains(species.lower()))
    gene = F.upper(F.trim(F.element_at(F.split(F.col(f"`{named[1]}`"), "[;,/]"), 1)))
    e = t.select(F.trim(f"`{named[0]}`").alias("left"), gene.alias("right"))
    absent = ("", "NA", "N/A", "-")
    return e.where(~F.col("left").isin(*absent) & ~F.col("right").isin(*absent)).distinct()
