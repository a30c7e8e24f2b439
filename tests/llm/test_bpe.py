import base64
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeloam.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
CODER = bpe.Encoder(RANKS)
RIGHT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
ALPHABET = [*"'''stmdrevl  \n\t\r\x1c\x85aZé9²¾٣.,!$-_", "'re", "'ll", "don't", "  ", "́", "中", "😀"]


def test_equals_the_library_on_random_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(3000)] + ["", " ", "a" * 4000, "ab" * 2000 + "'s", " " * 3000, "'" * 200]
    for text, (n, ids) in zip(texts, CODER.encode_batch(texts), strict=True):
        assert ids.tolist() == RIGHT.encode_ordinary(text) and n == len(ids)
        assert CODER.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_round_trip(texts):
    assert [CODER.decode(ids).decode() for _, ids in CODER.encode_batch(texts)] == texts


def test_long_texts_are_cut_only_where_slices_begin(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices([*ALPHABET, " "], k=3000)) for _ in range(5)] + ["x" * 900, " \n" * 700 + "y"]
    whole = [ids.tolist() for _, ids in CODER.encode_batch(texts)]
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    assert [ids.tolist() for _, ids in bpe.Encoder(RANKS).encode_batch(texts)] == whole
    assert [n for n, _ in CODER.encode_batch(texts, only_counts=True)] == [len(x) for x in whole]


def test_cache_limit_changes_nothing(monkeypatch):
    texts = [f"word{i} other{i * 7}" for i in range(300)]
    whole = [ids.tolist() for _, ids in CODER.encode_batch(texts)]
    monkeypatch.setattr(bpe, "CACHE_SLICES", 5)
    small = bpe.Encoder(RANKS)
    assert [small.encode(t) for t in texts] == whole


def test_added_tokens_as_the_vocabulary_file_has_them():
    path = P.path("byte_bpe_50k.json")
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>'s  ", "<|endoftext", ""]
    right = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for _, ids in bpe.Encoder(path).encode_batch(texts)] == right


def test_offsets_place_every_token():
    ids = CODER.encode("größer, 中文 don't")
    at = CODER.offsets(ids)
    raw = CODER.decode(ids)
    assert [raw[a:b] for a, b in zip(at, at[1:])] == [CODER.vocabulary[i] for i in ids]
