from brindle.engine import sparql
from brindle.streaming.ingest import ingest, line_stream


def test_files_are_read_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "1.nt").write_text("<a> <p> <b> .\n<a> <p> <b> .\n<a> <p .\n# note\n")
    for _ in range(2):
        ingest(line_stream(spark, str(folder)), str(out), str(tmp_path / "state"), once=True).awaitTermination()
        (folder / "2.nt").write_text('<b> <p> "x" .\n<b> <p> .\n')
    triples = spark.read.parquet(f"{out}/triples")
    assert sorted((r.s, r.o) for r in triples.collect()) == [("<a>", "<b>"), ("<b>", '"x"')]
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(f"{out}/rejects").collect()) == [("1.nt", "quoting"), ("2.nt", "column_count")]
    assert sparql(triples, "SELECT ?x WHERE { <a> <p> ?b . ?b <p> ?x }").collect()[0].x == '"x"'
