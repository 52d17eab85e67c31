"""The public tokenizers of the token operators: their files, versions, texts in independent parts and tokens as bytes."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from .bpe import _byte_letters

#: A longer text is handed to a library in parts of about so many characters, which bounds what the library holds.
PART = 1 << 20
#: A single space between word characters: both libraries begin a new word there.
BETWEEN_WORDS = re.compile(r"(?<=\w) (?=\w)")


def public_path(name: str) -> str:
    """The file of a public tokenizer on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The whole text in parts that are tokenised independently of each other; each but the first begins with a space.

    A text without a single space between word characters stays whole."""
    start = 0
    while len(text) - start > size and (cut := BETWEEN_WORDS.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


@lru_cache(maxsize=4)
def library(path: str, special: bool = True):
    """The library's tokenizer for a file, without truncation and padding. ``special``: special strings inside a text
    count as special tokens, as is the tokenizers library's default; sentencepiece never takes them from texts."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = not special
    return tokenizer


@lru_cache(maxsize=4)
def splits_at_spaces(path: str) -> bool:
    """Whether ``parts`` may cut texts for this tokenizer: a byte-level pattern that gives a space to the word after it,
    or pieces none of which continues beyond a word's end."""
    if path.endswith(".model"):
        sp = library(path)
        marked = re.compile("[^▁]▁")
        return not any(marked.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    cut_by_space = any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre["add_prefix_space"] and not spec["normalizer"] and not cut_by_space


def ids_of(path: str, texts: list[str], special: bool = True) -> Iterator[list[int]]:
    """The ids of each whole text, without begin, end or other tokens that a library adds."""
    tool, cuts = library(path, special), splits_at_spaces(path)
    short = [t for t in texts if len(t) <= PART or not cuts]
    if path.endswith(".model"):
        whole = iter(tool.encode(short, num_threads=1))
        for t in texts:
            if len(t) <= PART or not cuts:
                yield next(whole)
            else:  # the library puts the space that a part begins with itself
                yield [i for k, p in enumerate(parts(t)) for i in tool.encode(p[1:] if k else p)]
    else:
        whole = iter(tool.encode_batch_fast(short, add_special_tokens=False))
        for t in texts:
            if len(t) <= PART or not cuts:
                yield next(whole).ids
            else:
                yield [i for p in parts(t) for i in tool.encode(p, add_special_tokens=False).ids]


#: Characters up to U+024F, whose classes are the same in all versions of Unicode: letters, numbers, white space.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_BEYOND = re.compile("[^\\x00-\u024f]")
#: Fixed value: the byte-level tokenizers' pattern of words, over those characters.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class WordCache:
    """The ids that a byte-level tokenizer of the tokenizers library gives, special strings being plain text. It merges
    inside words only, so each distinct word is handed to the library once for as long as it is kept; texts with
    characters beyond U+024F are handed to it whole."""

    def __init__(self, path: str, most: int = 200_000) -> None:
        self.path, self.most = path, most
        self.tool, self.cuts = library(path, False), splits_at_spaces(path)
        self.known: dict[str, list[int]] = {}

    def ids_of(self, texts: list[str]) -> Iterator[list[int]]:
        words = [None if not self.cuts or _BEYOND.search(t) else _WORDS.findall(t) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        missing = [*set().union(*(w for w in words if w)).difference(self.known)]
        for word, found in zip(missing, self.tool.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            self.known[word] = found.ids
        get = self.known.__getitem__
        for text, w in zip(texts, words, strict=True):
            yield next(iter(ids_of(self.path, [text], special=False))) if w is None else [*chain.from_iterable(map(get, w))]


def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for."""
    if path.endswith(".model"):
        sp = library(path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
    tool = library(path)
    return [bytes(byte_of[x] for x in tool.id_to_token(i)) for i in range(tool.get_vocab_size())]


@lru_cache(maxsize=4)
def version(path: str, special: bool = True) -> str:
    """A digest of all that a count depends on besides the text: the file, its library and that one's version."""
    module = __import__("sentencepiece" if path.endswith(".model") else "tokenizers")
    digest = hashlib.sha256(f"{module.__name__} {module.__version__} special={special}\n".encode())
    with open(path, "rb") as f:
        digest.update(f.read())
    return digest.hexdigest()
