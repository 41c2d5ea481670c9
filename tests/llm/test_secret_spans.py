"""Model spans beside base spans."""

import hashlib

from lexispark.llm import secrets

from .common_data import frame


def test_a_model_span_stays_unless_a_base_span_covers_it(spark):
    ratios = secrets.train(secrets.sample_tokens(spark))
    inner = hashlib.md5(b"x").hexdigest()
    texts = [f"see Qz7RkW9vXbT2mLpT{inner}Zk8QwX3vRt6YbN1c, there", f"see {inner}, there", f'token = "{inner}"']
    got = {r.doc_id: [(secrets.KINDS[s.kind], r.text[s.start : s.end]) for s in r.spans] for r in secrets.scan(frame(spark, list(enumerate(texts))), ratios).collect()}
    assert got[0] == [("markov", texts[0][4:-7]), ("hex", inner)]
    assert got[1] == [("hex", inner)] and {k for k, _ in got[2]} == {"assign", "hex"}
