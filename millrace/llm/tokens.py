"""Token ids by the tokenizers library, with a memory of the words already encoded.

Every id comes from the library. A text made of characters whose classes no Unicode version
disputes is cut into the pieces that the tokenizer's own pre-tokenizer would cut; each new
piece is encoded by the library's model once and remembered. Any other text, and any that may hold a
special token, goes to the library whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

# Character classes of the tokenizer files' patterns within the plain range.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: Byte-level models' characters: a visible Latin-1 character for itself, the next from 256 on for each other byte.
VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARACTERS = {b: chr(b if b in VISIBLE else 256 + sum(x not in VISIBLE for x in range(b))) for b in range(256)}

BYTE_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
BYTE_PIECES = re.compile(
    rf" ?[{LETTERS}]+|{CONTRACTIONS}| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
)
WORD_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ž]*")
WORD_PIECES = re.compile(rf"[{LETTERS}]+|{CONTRACTIONS}|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: What WORD_PIECES stands for, as a tokenizer file writes it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
#: What stands before the model, apart from a flag that only offsets depend on.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
WORD_CUT = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
#: Options of the model: others could make ids of a piece depend on more than the piece.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: Words remembered by one worker; a bound on memory (about 200 bytes each), not on what is encoded.
MEMORY = 400_000
SPECIAL = "<|"


def family(spec: dict) -> str | None:
    """"byte" or "word" if the pieces can be cut here exactly as the file says, in every option that decides ids, else None."""
    if any(not t["content"].startswith(SPECIAL) for t in spec.get("added_tokens", [])) or spec.get("post_processor"):
        return None
    model = spec["model"]
    if any(model.get(k, v) != v for k, v in MODEL.items()):
        return None

    def before(given: dict | None) -> dict:
        return {k: v for k, v in (given or {}).items() if k != "trim_offsets"}

    cut = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is None and before(cut) == BYTE_LEVEL:
        return "byte"
    parts = cut.get("pretokenizers", []) if cut.get("type") == "Sequence" else []
    if spec.get("normalizer") == WORD_NORMALIZER and list(map(before, parts)) == [WORD_CUT, BYTE_LEVEL | {"use_regex": False}]:
        return "word"
    return None


class Memory(dict):
    """Pieces and their ids. One not yet known gets an empty buffer, which is noted in ``new`` and filled later."""

    def __init__(self):
        self.new: dict[str, bytearray] = {}

    def __missing__(self, piece: str) -> bytearray:
        self[piece] = self.new[piece] = bytearray()
        return self[piece]


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, memory: int | None = None):
        from tokenizers import Tokenizer

        self.limit = memory

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.family = family(json.load(f))
        self.memory = Memory()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = {"byte": BYTE_PLAIN, "word": WORD_PLAIN}.get(self.family)
        cut = {"byte": BYTE_PIECES, "word": WORD_PIECES}.get(self.family)
        if self.memory.new:  # an error left buffers empty
            self.memory = Memory()
        quick = [bool(plain) and SPECIAL not in t and plain.fullmatch(t) is not None for t in texts]
        whole = iter(self._library([t for t, q in zip(texts, quick, strict=True) if not q]))
        lower, ids = self.family == "word", self.memory.__getitem__
        found = [list(map(ids, cut.findall(t.lower() if lower else t))) if q else None for t, q in zip(texts, quick, strict=True)]
        new, self.memory.new = self.memory.new, {}
        self._learn(new)
        out = [next(whole) if f is None else b"".join(f) for f in found]
        if len(self.memory) > (self.limit or MEMORY):  # the words met first, and so the frequent ones, stay
            for piece in new:
                del self.memory[piece]
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: dict[str, bytearray]) -> None:
        """Encode new pieces by the library's model, which sees each byte as a character, and fill their buffers."""
        tokenize = self.library.model.tokenize
        made = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(BYTE_CHARACTERS))] for p in new]
        raw = np.array([i for ids in made for i in ids], "<u4").tobytes()
        ends = (np.cumsum([len(ids) for ids in made]) * 4).tolist()
        for (piece, buffer), a, b in zip(new.items(), [0, *ends], ends, strict=False):
            self.memory[piece] = raw[a:b]
            buffer += raw[a:b]


_loaded: dict[str, Encoder] = {}


def encoder(path: str, memory: int | None = None) -> Encoder:
    """This worker's encoder for a tokenizer file, which may remember ``memory`` pieces; workers are reused, and so is it."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    _loaded[path].limit = memory
    return _loaded[path]


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
