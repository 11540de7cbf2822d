"""Addresses whose `@` is written out, and added spans beside fixed ones."""

from riskloom.llm import pii


def test_written_out_address_without_digits(spark):
    texts = [f"call me on +49 30 12345{i} or mail jo.doe{'abc'[i % 3]}@site.example.org from 10.1.2.{i}" for i in range(10, 40)]
    text = "please write to jane.doe at example.com when you are there"
    docs = spark.createDataFrame([*enumerate(texts), (100, text), (101, "we met at noon. then home")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["pii_spans"]] for r in pii.find_pii(docs, pii.fit_field(docs, "text", "doc_id")).collect()}
    assert [(k, text[a:b], base) for k, a, b, base in got[100]] == [("email", "jane.doe at example.com", False)] and got[101] == []


def test_fixed_spans_bound_added_ones():
    field = pii.Field()
    field.fitted, field.w[3, [0, 5, 7]] = True, [2, 3, 9]
    text = "x 49 30 1234567 10.0.0.1 y"
    assert pii.scan(text, field) == [("ip", 16, 24, True), ("phone", 2, 15, False)]
