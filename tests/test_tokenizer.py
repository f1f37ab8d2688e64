"""BPE encoder against the ``tokenizers`` package with the same vocabulary."""

import random

from corpusmap.operators import tokenizer as TOK


def _hf(model):
    from tokenizers import Tokenizer, models, normalizers
    inv = sorted(model.vocab.items(), key=lambda kv: kv[1])
    merges = sorted(model.rank.items(), key=lambda kv: kv[1])
    bpe = models.BPE(vocab=dict(inv), merges=[m for m, _ in merges], unk_token="<unk>", byte_fallback=True,
                     ignore_merges=False)
    tok = Tokenizer(bpe)
    tok.normalizer = normalizers.Replace(" ", TOK.SPACE)
    return tok


def test_matches_tokenizers_package():
    m = TOK.demo_model()
    hf = _hf(m)
    rnd = random.Random(1)
    alphabet = "etaoinshrdl etaoin xyzÉé€ 😀.,"
    texts = ["", "the sea", "hello world", "éé", "a  b"] + \
        ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    for t in texts:
        ours = m.encode(t)
        ref = hf.encode(t, add_special_tokens=False).ids
        assert ours[1:-1] == ref, (t, ours, ref)
        assert ours[0] == m.bos_id and ours[-1] == m.eos_id


def test_corpus_job(spark):
    df = spark.createDataFrame([(1, "the sea"), (2, "")], "id long, text string")
    out = {r.id: r for r in TOK.tokenize_corpus(df, "id", "text", TOK.demo_model(), max_tokens=3).collect()}
    assert out[1].n_tokens == 3 and out[2].n_tokens == 2


def test_memo_keeps_no_long_segments():
    """what a worker remembers is bounded by segments and their length; ids are the same."""
    from corpusmap.operators import tokenizer as T
    model = T.demo_model()
    text = "the" * 200 + " tea"
    first = model.encode(text)
    assert model.encode(text) == first and all(len(s) <= T.MEMO_CHARS for s in model.memo) and T.MEMO_LIMIT <= 50_000
