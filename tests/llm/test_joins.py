"""The forms that take over where something is too large to be sent to every task."""

import numpy as np
import sentencepiece

from rasterloom.llm import pieces, topk, warc
from rasterloom.llm.catalog import TOKENIZERS


def test_warc_marks_by_a_join(spark):
    """Copies of one page hold a third of the rows, with and without ids."""
    rows = [(i, f"u{i}", "<p>same</p>" if i % 3 == 0 else f"<p>{i}</p>") for i in range(600)] + [(None, "n", "<p>same</p>"), (None, "n", "<p>own</p>"), (5, "again", "<p>5</p>"), (700, "e", None), (701, "e", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.normalise(warc.write(table, broadcast_rows=most))).collect()), key=repr) for most in (0, 200_000)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert {x[3] for x in got[0] if x[2] == "revisit"} == {597, 701}


def test_topk_by_a_join(spark):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.normal(0, 1, 5 + i % 2).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    index = topk.build_index(table, pivots=3)
    asked = index.table.where("vec_id % 50 = 0")
    rows = lambda **options: sorted(map(tuple, topk.search(index, asked, **options).select("query_id", "rank", "vec_id", "score").collect()))
    assert rows() == rows(broadcast_bytes=0, query_block=2) == rows(query_block=3) and len(rows()) == 40


def test_the_models_rule_for_normalising_is_read():
    whole = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model").serialized_model_proto()
    assert pieces.marks_spaces_only(whole)
    rule = lambda fields: whole + bytes([3 << 3 | 2, len(fields)]) + fields  # noqa: E731  the last one counts
    assert pieces.marks_spaces_only(rule(bytes([4 << 3, 0])))
    for fields in (b"", bytes([4 << 3, 1]), bytes([4 << 3, 0, 3 << 3, 0]), bytes([4 << 3, 0, 5 << 3, 0]), bytes([4 << 3, 0, 2 << 3 | 2, 1, 65])):
        assert not pieces.marks_spaces_only(rule(fields))
