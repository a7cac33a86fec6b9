from brindle.sources.termids import decode_triples, encode_triples, number_terms, term_zones

ROWS = [("<b>", "<p>", "<a>"), ("<a>", "<p>", '"x"'), ("<b>", "<q>", '"x"'), ("<b>", "<q>", '"x"'), ("<é>", "<p>", "<a>"), (None, "<p>", "<z>"), ("<y>", "<p>", None)]


def test_dense_ids_and_round_trip(spark, tmp_path):
    triples = spark.createDataFrame(ROWS, "s string, p string, o string")
    assert {(r.term, r.zone) for r in term_zones(triples).collect()} == {("<a>", "shared"), ("<b>", "subject"), ("<y>", "subject"), ("<é>", "subject"), ('"x"', "object"), ("<z>", "object")}
    terms = number_terms(spark, triples, str(tmp_path / "terms"))
    assert [r.term for r in terms.orderBy("term_id").collect()] == ["<a>", "<b>", "<y>", "<é>", '"x"', "<z>"]
    assert [r.term_id for r in terms.orderBy("term_id").collect()] == [1, 2, 3, 4, 5, 6]
    whole = triples.where("s is not null and o is not null")
    back = decode_triples(encode_triples(triples, terms), terms)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, whole.collect()))
    assert number_terms(spark, triples.limit(0), str(tmp_path / "none")).collect() == []
