"""Language ID learns from words of any length."""

import numpy as np

from retailforge.llm import common, langid
from tests.conftest import spark  # noqa: F811,F401


def test_expected_counts_of_long_words(monkeypatch):
    p = langid.pieces(langid.VOCABULARY)
    rng = np.random.default_rng(2)
    probs = rng.random((p.n, 2))
    scaled = probs / probs.sum(0) * langid.SCALE ** p.size[:, None]
    words = sorted([b"the", "été".encode(), "日本語の文章は空白なしで続きます".encode(), b"internationalization", b"ab" * 30], key=len)
    counts = rng.integers(1, 9, (5, 2)).astype(float)
    want = p.expected(words, counts, scaled)
    assert np.allclose(p.expected_long(words, counts, scaled), want)
    monkeypatch.setattr(langid, "LONG_CELLS", 1)  # one word at a time
    assert np.allclose(p.expected_long(words, counts, scaled), want)
    n = 30_000  # far beyond the range of unscaled products: expected bytes add up to the word
    far = p.expected_long([b"q" * n], np.ones((1, 2)), scaled)
    assert np.allclose((far * p.size[:, None]).sum(0), n + len(langid.MARK.encode()))


def test_languages_without_blanks(spark):  # noqa: F811
    common.prepare(spark)
    signs = {"a1": "的一是在不了有和人这中大为上个国我以要他", "b1": "日本語文章空白続東京都市駅前電車毎朝新聞"}
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list(signs[g]), 60)), g) for i in range(60) for g in signs]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert all(r.lang_pred == r.row.lang and r.score > 0.9 for r in got)
