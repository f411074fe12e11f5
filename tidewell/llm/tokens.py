"""Token ids of a tokenizer file, for whole columns of texts.

The ids are those of ``tokenizers.Tokenizer.encode(text, add_special_tokens=False)``. As that library
takes some 20 microseconds a word, each worker keeps the ids of the words it has seen, and merges the plain
words that are new with tiktoken's byte-pair core, whose ranks are made from the same file. Whatever isn't plain goes to
the tokenizer itself, and so does everything if the two ever disagree on a worker's first words.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: How many words a worker keeps; more are computed anew.
MEMO_WORDS = 500_000
#: So many of a worker's first words are encoded in both ways.
COMPARED_WORDS = 300
#: Printable ASCII and Latin letters, for which lower case and normal form are simple.
PLAIN = re.compile(r"[\x21-\x7e\xa1-įı-ɏ]*\Z")
#: The split pattern of the tokenizer file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: str.split() takes these for space, Unicode doesn't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts by one tokenizer file; made once in each worker."""

    _made: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.compared = 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merge = self._core(spec)

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _core(self, spec: dict):
        """tiktoken's merges for a vocabulary with word ends; None if the file is of another kind.

        The byte 255, which UTF-8 never has, stands for a word's end. Its merge with the last byte comes
        first, then the file's merges in their order.
        """
        model = spec["model"]
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or normal != ["NFC", "Replace", "Lowercase"]:
            return None
        if WORD_PATTERN not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            return None
        import regex
        import tiktoken

        letters = _byte_of_letter()

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(letters[c] for c in (token[:-4] if end else token)) + b"\xff" * end

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(a + b), 512 + i)
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.id_of_rank = np.zeros(max(ranks.values()) + 1, self.dtype)
        for token, rank in ranks.items():
            self.id_of_rank[rank] = ids.get(token, 0)
        self.split = regex.compile(WORD_PATTERN).findall
        return tiktoken.Encoding("words", pat_str=r"[^\xff]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _plain(self, chunk: str) -> bytes:
        out = []
        for word in self.split(chunk.lower()):
            got = self.words.get(word)
            if got is None:
                got = self.id_of_rank[self.merge(word.encode() + b"\xff")].tobytes()
                if len(self.words) >= MEMO_WORDS:
                    self.words.clear()
                self.words[word] = got
            out.append(got)
        return b"".join(out)

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _new(self, chunk: str) -> bytes:
        if self.merge is None or not PLAIN.match(chunk) or "<|" in chunk:
            return self._slow(chunk)
        got = self._plain(chunk)
        if self.compared < COMPARED_WORDS:
            self.compared += 1
            if got != (slow := self._slow(chunk)):
                self.merge = None
                return slow
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian numbers of ``self.dtype``. White space separates words and has no ids."""
        if any(c in text for c in ODD_SPACES):
            return self._slow(text)
        chunks = text.split()
        memo = self.memo
        try:
            return b"".join([memo[c] for c in chunks])
        except KeyError:
            pass
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = []
        for c in chunks:
            got = memo.get(c)
            if got is None:
                got = self._new(c)
                if len(c) <= 64:
                    memo[c] = got
            out.append(got)
        return b"".join(out)
