"""Readers, writers and streams over small files."""

import gzip

from pyspark.sql import functions as F

from quern.sources import readers, sinks
from quern.streaming import windows

DATA = "/root/testdata/sf0.001"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_text_formats(spark, tmp_path):
    g = put(tmp_path / "a.gmt", "S1\tfirst\tTP53\tegfr\nS2\t\tKRAS\nbad\n")
    assert {(r.set, r.gene) for r in readers.gmt(spark, g).collect()} == {("S1", "TP53"), ("S1", "EGFR"), ("S2", "KRAS")}
    names = put(tmp_path / "n.txt", "gene\nA\n\nB\nA\n")
    assert {r.gene for r in readers.name_list(spark, names).collect()} == {"A", "B"}
    v = put(tmp_path / "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t5\trs1\ta\tG\t.\t.\t.\tES:SE:LP:AF\t0.1:0.02:3:0.4\n1\t6\trs2\tA\tG\t.\t.\t.\tSE:ES\t0.2:0.3\n")
    rows = {r.snp: r for r in readers.gwas_vcf(spark, v).collect()}
    assert abs(rows["rs1"].p - 1e-3) < 1e-12 and rows["rs1"].other_allele == "A" and (rows["rs2"].beta, rows["rs2"].eaf) == (0.3, None)
    e = put(tmp_path / "e.tsv", "preferredName_A\tpreferredName_B\tscore\na\tb\t900\na\ta\t900\na\tc\t0.1\n")
    edges = readers.scored_edges(spark, e, {"src": ["preferredName_A"], "dst": ["preferredName_B"], "w": ["score"]})
    assert [tuple(r) for r in edges.collect()] == [("A", "B", 0.9)]
    assert readers.sniff(spark, e)[1] == "\t"
    assert readers.first_existing(spark, [str(tmp_path / "none"), e]) == e
    c = put(tmp_path / "c.tsv", "# c\nchem\tid\tx\tgene\t1\t2\t3\t4\t5\tincreases^expression|affects^binding\t123\n")
    assert {r.action for r in readers.interactions(spark, c).collect()} == {"expression", "binding"}


def test_series_matrix(spark, tmp_path):
    path = tmp_path / "s.txt.gz"
    with gzip.open(path, "wt") as f:
        f.write('!Series_title\t"t"\n!Sample_x\t"1"\t"2"\n!series_matrix_table_begin\n"ID_REF"\t"G1"\t"G2"\n"p1"\t1.5\tnull\n"p2"\t2\n!series_matrix_table_end\nafter\n')
    rows = {(r.probe, r["sample"]): r.value for r in readers.series_matrix(spark, str(path)).collect()}
    assert rows == {("p1", "G1"): 1.5, ("p1", "G2"): None, ("p2", "G1"): 2.0, ("p2", "G2"): None}
    meta = {r.key: r["values"] for r in readers.series_metadata(spark, str(path)).collect()}
    assert meta["Sample_x"] == ["1", "2"]


def test_sparse_matrix(spark, tmp_path):
    m = put(tmp_path / "m.mtx", "%%MatrixMarket\n%\n2 2 2\n1 1 5\n2 2 1\n")
    g, c = put(tmp_path / "g.tsv", "E1\tA\nE2\tB\n"), put(tmp_path / "c.tsv", "x\ny\n")
    got = {tuple(r) for r in readers.market_matrix(spark, m, g, c).collect()}
    assert {("x", "A", 5.0), ("y", "B", 1.0)} >= got and ("x", "A", 5.0) in got


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.to_csv(d, str(tmp_path / "c"))
    assert readers.delimited(spark, str(tmp_path / "c")).count() == 2
    sinks.to_parquet(d, str(tmp_path / "p"))
    sinks.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), str(tmp_path / "p"), ["k"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    sinks.per_key_csv(d, str(tmp_path / "k"), "k")
    assert (tmp_path / "k" / "k=a").is_dir()
    sinks.to_json(d, str(tmp_path / "j"))
    assert readers.json_records(spark, str(tmp_path / "j"), many_lines=False).count() == 2
    u = readers.union_files(spark, [str(tmp_path / "c"), put(tmp_path / "x.csv", "k,z\nq,1\n")])
    assert u.where("v is null").count() == 1


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = readers_stream = windows.new_files(spark, str(tmp_path / "in"), events)
    q = windows.windowed(readers_stream, "ts", "1 day", keys=["event_type"]).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("daily").collect()}
    batch = {tuple(r) for r in windows.windowed(events, "ts", "1 day", keys=["event_type"]).collect()}
    assert got and got <= batch and stream.isStreaming
    assert windows.first_of_each(events.union(events), "ts", ["event_id"]).count() == events.count()


def test_series_matrix_in_splits(spark, tmp_path):
    """A file that is cut into many ranges has the same rows, metadata and heading as when it is read as a whole."""
    import pathlib

    n = 40_000
    folder = tmp_path / "series"
    folder.mkdir()
    for name, sample in (("a.txt", "G1"), ("b.txt", "G2")):
        head = ['!Series_title\t"' + "t" * 3000 + '"', f'!Sample_x\t"{sample}"', "before", "!series_matrix_table_begin", f'"ID_REF"\t"{sample}"\t"both"']
        pathlib.Path(folder / name).write_text("\n".join(head + [f'"p{i}"\t{i}.5\t{i}' for i in range(n)] + ["!series_matrix_table_end", '"after"\t1\t2']) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = readers.series_matrix(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        got = {(r.probe, r["sample"]): r.value for r in rows.collect()}
        assert len(got) == 3 * n and rows.count() == 4 * n
        assert all(got[f"p{i}", "G1"] == i + 0.5 == got[f"p{i}", "G2"] and got[f"p{i}", "both"] == i for i in range(n))
        assert {r.key: r["values"] for r in readers.series_metadata(spark, str(folder)).collect()}["Sample_x"] == ["G2"]
        names, entries = tmp_path / "names.tsv", tmp_path / "m.mtx"
        names.write_text("".join(f"E{i}\tname{i}\n" for i in range(1, n + 1)))
        entries.write_text(f"%%MatrixMarket\n{n} {n} {n}\n" + "".join(f"{i} {n + 1 - i} {i % 9 + 1}\n" for i in range(1, n + 1)))
        matrix = {(r.cell, r.gene): r.value for r in readers.market_matrix(spark, str(entries), str(names), str(names)).collect()}
        assert len(matrix) == n and all(matrix[f"name{n + 1 - i}", f"name{i}"] == i % 9 + 1 for i in range(1, n + 1, 777))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
