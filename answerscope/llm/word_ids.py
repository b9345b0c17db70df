"""Token ids of whole texts as the tokenizers library gives them for a lower-casing BPE file with word ends.

The library alone encodes 0.7 MB/s a core of the check's texts, most of whose words are rare. So:

- White space is dropped and no merge crosses it: the ids of a text are those of its stretches between white space. Arrow
  splits a batch of texts and numbers its distinct stretches, each is encoded once, and numpy lays the ids out.
- Stretches are cut into the pre-tokenizer's pieces and encoded by tiktoken from the same vocabulary, with the end of
  a word as a byte of its own: a last byte and this mark merge before all else, as their ids are below all merges'.
  tiktoken merges two tokens wherever their joint bytes are a token; the library only if the two are listed. That is the
  same where every token's own bytes merge into itself (`sound`, tested when a file is opened): two neighbours that join
  to a token by another cut would, by the same merges, also be what the token's bytes end as.
- Lower case, normal form and classes of characters are settled for KNOWN. A text with any other character, or with the
  beginning of a special string, and every text of a file that isn't sound, goes to the library as a whole.

Tests compare with the library over all of KNOWN and over the given texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _spans(chars: list[str]) -> str:
    """A character class of chars, in ranges."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def _known() -> list[str]:
    """Characters of Latin, Greek and Cyrillic, punctuation and currency that have one case form and one normal form each, and the usual white space."""
    ranges = [(0x20, 0x7F), (0xA1, 0x250), (0x391, 0x3A2), (0x3A4, 0x3CA), (0x400, 0x460), (0x2010, 0x2028), (0x20A0, 0x20BE)]
    held = {chr(c) for a, b in ranges for c in range(a, b)} - {"İ", "ς"}
    settled = {c for c in held if c.lower() in held and unicodedata.normalize("NFC", c) == c and unicodedata.category(c)[0] in "LNPSZ"}
    return sorted(settled | set(" \t\n\r"))


KNOWN = _known()
UNKNOWN = re.compile(f"[^{_spans(KNOWN)}]")
_LETTERS, _DIGITS = (_spans([c for c in KNOWN if unicodedata.category(c)[0] == kind]) for kind in "LN")
#: The pre-tokenizer's pattern (a fixed value of the format), with its classes spelled out.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile(CUT.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _DIGITS))
WORD_END = "</w>"
#: The end of a word, and an empty word that stands between stretches; neither is in KNOWN.
END, BETWEEN = "\x01", "\x02"

_encoders: dict[str, WordIds] = {}


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(c): c for c in shown} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in shown)}


def sound(vocab: dict[str, int], merges: list[tuple[str, str]]) -> bool:
    """Whether the base tokens are the 256 bytes and the 256 with a word's end, the n-th merge makes the n-th other id, and every token's own parts merge into it."""
    base = 2 * 256
    rank = {pair: n for n, pair in enumerate(merges)}
    if len(rank) != len(merges) or any(vocab.get(a + b) != base + n for n, (a, b) in enumerate(merges)):
        return False
    for a, b in merges:
        token = a + b
        parts = [*token.removesuffix(WORD_END)]
        if token.endswith(WORD_END):
            parts[-1] += WORD_END
        while len(parts) > 1:
            n, at = min((rank.get(pair, base + len(rank)), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if n > len(rank):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class WordIds:
    def __init__(self, json_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        import tiktoken
        from tokenizers import Tokenizer

        with open(json_path, encoding="utf-8") as f:
            told = json.load(f)
        model, of = told["model"], _bytes_of()
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        cuts = [x["pattern"]["Regex"] for x in told["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        self.library = Tokenizer.from_file(json_path)
        self.fast = cuts == [CUT] and model.get("end_of_word_suffix") == WORD_END and sound(model["vocab"], merges)
        if self.fast:
            special = {x["content"] for x in told["added_tokens"]}
            raw = lambda t: bytes(of[c] for c in t.removesuffix(WORD_END)) + END.encode() * t.endswith(WORD_END)
            ranks = {raw(t): n for t, n in model["vocab"].items() if t not in special}
            self.between = len(model["vocab"]) + len(special)
            ranks[BETWEEN.encode() + END.encode()] = self.between
            self.words = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _each(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch."""
        pieces = PIECES.findall(f" {BETWEEN} ".join([*stretches, ""]))
        ids = np.array(self.words.encode_ordinary(END.join([*pieces, ""])), "<u4")
        raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.between) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]  # the last begins where no stretch is

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        out: list[np.ndarray | None] = [None] * len(texts)
        known = [k for k, t in enumerate(texts) if self.fast and "<|" not in t and not UNKNOWN.search(t)]
        for k in set(range(len(texts))).difference(known):
            out[k] = np.frombuffer(self.exact(texts[k]), "<u4")
        if known:
            split = pc.ascii_split_whitespace(pa.array([texts[k].lower() for k in known], pa.large_string()))
            numbered = split.values.dictionary_encode()
            ids = self._each(numbered.dictionary.to_pylist())
            of = numbered.indices.to_numpy(zero_copy_only=False)
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            start, sizes = np.cumsum(size) - size, size[of]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            laid = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[of] - ends[:-1], sizes) + np.arange(ends[-1])]
            cuts = ends[split.offsets.to_numpy(zero_copy_only=False)]
            for k, a, b in zip(known, cuts[:-1], cuts[1:], strict=True):
                out[k] = laid[a:b]
        return out


def word_ids(json_path: str) -> WordIds:
    """One for each Python worker."""
    if json_path not in _encoders:
        _encoders[json_path] = WordIds(json_path)
    return _encoders[json_path]
