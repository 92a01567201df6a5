"""What leaves the pipeline's last stage."""

import corpus_pipeline
from pixelwell.llm.tokens import public_path


def test_last_stage_returns_token_ids(spark):
    from tokenizers import Tokenizer

    texts = {1: "One two three.", 2: "", 3: None}
    out = dict(corpus_pipeline.STAGES)["encode"](spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "")
    t = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    assert {r.doc_id: list(r.ids) for r in out.collect()} == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}
