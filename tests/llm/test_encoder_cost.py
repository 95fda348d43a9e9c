"""Latin words with accents are merged once, whatever case or mark they come with."""

from __future__ import annotations

from types import SimpleNamespace

from chronomesh.llm import tokens
from chronomesh.llm.queries import tokenizer_path


def test_accented_words_are_merged_once():
    mine, merged = tokens.WordEncoder(tokenizer_path()), []
    piece = mine.bpe._core_bpe.encode_single_piece
    mine.bpe = SimpleNamespace(_core_bpe=SimpleNamespace(encode_single_piece=lambda b: merged.append(b) or piece(b)))
    texts = ["épée, Épée. ÉPÉE!", "Épée; épée"]
    for text in texts:
        assert mine.ids(text).tolist() == mine._encode(text).tolist()
    assert merged == ["épée".encode() + tokens.END]


def test_every_plain_letter():
    """Alone, in words, before marks and beside digits, as the tokenizer has it."""
    mine = tokens.WordEncoder(tokenizer_path())
    for c in map(chr, range(0x21, 0x180)):
        for word in (c, f"a{c}", f"{c}{c}b.", f"{c}É{c},", f"x{c}7", f"K{c}", f"{c}́"):
            assert mine.ids(f"{word} {word}").tolist() == mine._encode(f"{word} {word}").tolist(), word


def test_a_failure_leaves_no_words_without_ids():
    mine = tokens.WordEncoder(tokenizer_path())
    learn, mine._learn = mine._learn, lambda words: 1 / 0
    try:
        mine.ids("some words")
    except ZeroDivisionError:
        mine._learn = learn
    assert mine.ids("some words").tolist() == mine._encode("some words").tolist()
