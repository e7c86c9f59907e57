"""Exact token ids at high speed, as the tokenizer file defines them for the whole text."""

from __future__ import annotations

import json
import os
import struct

import numpy as np


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on the machine where it is asked for."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: What the supported word-level vocabularies split by, after NFC and lower-casing; white space is dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end of a word in the bytes of a token; no word has such a byte.
WORD_END = b" "


def _ranks(spec: dict, suffix: str, first: int) -> dict[bytes, int] | None:
    """Tokens' bytes and ids, if the ids from `first` on follow the order of merges, so that merging by least id is the file's."""
    vocab, letters, special = spec["model"]["vocab"], _byte_letters(), {t["content"] for t in spec["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    if len(vocab) - len(special & set(vocab)) != first + len(pairs) or any(vocab[a + b] != first + i for i, (a, b) in enumerate(pairs)):
        return None
    ranks = {}
    for t, i in vocab.items():
        if t not in special:
            ended = bool(suffix) and t.endswith(suffix)
            ranks[bytes(letters[c] for c in (t[: -len(suffix)] if ended else t)) + (WORD_END if ended else b"")] = i
    return ranks if len(ranks) == first + len(pairs) else None


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1, which NFC leaves as they are."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes: those that tokenizers gives for the file.

    Strings that look like the file's added tokens are ordinary text, or, if `added`, get those tokens' ids, as
    tokenizers gives them by default.

    tokenizers decides on every text or word with a character beyond Latin-1, since libraries differ in the version of
    Unicode whose letters, numbers and small forms they know. Latin-1 text under two kinds of vocabulary file whose ids
    follow their merges is run by tiktoken, which merges by least id and takes a quarter of the time: byte-level files,
    and lower-case ones with word ends that drop white space. For the latter, texts are cut at spaces and line feeds,
    over which nothing reaches, and each distinct cutting is encoded once while it is remembered. Tests hold every
    Latin-1 character, alone and among others, against tokenizers.
    """

    #: Distinct cuttings that are remembered, and as many older ones.
    REMEMBER = 200_000

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.whole = self.words = None
        self.added = [t["content"] for t in spec.get("added_tokens") or []] if added else []
        if not normal and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not model.get("end_of_word_suffix"):
            from public_tokenizers import PATTERN

            ranks = _ranks(spec, "", 256)
            self.whole = ranks and tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        elif model.get("end_of_word_suffix") and WORD_PATTERN in json.dumps(before).replace("\\\\", "\\") and [n["type"] for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            import regex

            ranks = _ranks(spec, model["end_of_word_suffix"], 512)
            self.words = ranks and tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
            self.split, self.known, self.older = regex.compile(WORD_PATTERN + r"|\n").findall, {}, {}
            if self.words:
                self.ended = np.zeros(max(ranks.values()) + 1, bool)
                self.ended[[i for t, i in ranks.items() if t.endswith(WORD_END)]] = True

    def encode(self, text: str) -> bytes:
        if not (self.whole or self.words) or any(t in text for t in self.added):
            return self._ids(text)
        if self.whole:
            return np.ascontiguousarray(self.whole.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes() if _latin(text) else self._ids(text)
        parts = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) > self.REMEMBER:
                self.known, self.older = {}, self.known
            self._learn([p for p in dict.fromkeys(parts) if p not in self.known])
            return b"".join(map(self.known.__getitem__, parts))

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of cuttings, all Latin-1 ones by one call; each word's last token ends it."""
        latin = []
        for p in parts:
            if p in self.older:
                self.known[p] = self.older[p]
            elif _latin(p):
                latin.append(p)
            else:
                self.known[p] = self._ids(p)
        words, cuts, n = self.split("\n".join(latin).lower()), [], 0
        for w in words:
            if w == "\n":
                cuts.append(n)
            else:
                n += 1
        ids = np.array(self.words.encode_ordinary("".join([w + " " for w in words if w != "\n"])), "<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.ended[ids]) + 1])[[*cuts, n]]
        raw, first = ids.tobytes(), 0
        for p, end in zip(latin, ends.tolist()):
            self.known[p] = raw[4 * first : 4 * end]
            first = end

    def _ids(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
