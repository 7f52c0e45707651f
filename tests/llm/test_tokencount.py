import random

from rasterloom.llm import tokencount


def library(pieces):
    from tokenizers import Tokenizer, models

    low = min(s for _, s in pieces)
    return Tokenizer(models.Unigram([("<unk>", low), *pieces], unk_id=0, byte_fallback=False))


def library_count(tok, text):
    return sum(len(tok.encode(tokencount.MARK + w, add_special_tokens=False).ids) for w in tokencount._split(text))


def test_like_the_library_with_many_ties():
    rng = random.Random(3)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab" + tokencount.MARK) for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 4)) for _ in range(8)}
        pieces = list(pieces.items())
        tok, own = library(pieces), tokencount.PieceCounter(pieces)
        for _ in range(40):
            word = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 9)))
            assert own.pieces(tokencount.MARK + word) == len(tok.encode(tokencount.MARK + word, add_special_tokens=False).ids), (pieces, word)


def test_query(spark, rows, sf_dir):
    pieces = tokencount.vocabulary()
    tok = library(pieces)
    want = sorted((i, library_count(tok, t or "")) for i, t in rows[0])
    assert sorted(tuple(r) for r in tokencount.query(spark, sf_dir).collect()) == want


def test_cache_bound_changes_nothing(monkeypatch):
    pieces = tokencount.vocabulary()
    text = " ".join(str(i * 7919) for i in range(200)) * 2
    want = tokencount.PieceCounter(pieces).text(text)
    monkeypatch.setattr(tokencount, "CACHE", 3)
    assert tokencount.PieceCounter(pieces).text(text) == want


def test_empty(spark, empty_dir):
    assert tokencount.query(spark, empty_dir).count() == 0
