"""Ids of whole texts through a memory of short pieces.

A text is cut where no tokenizer of these kinds can join: before a single space that is followed by a visible character.
Texts are taken some millions of characters at a time; Arrow splits them and finds the distinct pieces, and of these only those
that the worker does not remember go to the tokenizer, all in one call.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chunkloom.llm.common import in_worker

#: White space to Unicode or to one of the regex libraries; before it no cut is made.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = re.compile(f" (?:[{BLANK}]|$)")
CUT = re.compile(f" (?=[^{BLANK}])")
#: Pieces and words that a worker remembers (about 200 bytes each); the first ones stay, common ones come early.
#: After so many misses it forgets them and starts anew.
PIECES, WORDS, FORGETS = 200_000, 400_000, 20_000_000
#: Stands between pieces. Texts that hold it are encoded whole.
PART = "\0"
#: Longer pieces are encoded each time.
LONGEST = 100
STEP_CHARS = 2_000_000
#: Letters of the commonest scripts with marks behind them, perhaps a line end and the same again: nearly all pieces look like that.
#: Without U+0130, which a lowering tokenizer makes a letter and a mark.
LETTER, MARK = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]", r"[!-&(-/:-@\[-`{-~]"
LETTERS, MARKS = f"{LETTER}+", f"{MARK}*"
PLAIN = {space: re.compile(f"({space and ' ?'}{LETTERS})({MARKS})(?:(\n)({LETTERS})({MARKS}))?\\Z") for space in ("", " ")}
#: Such marks after a letter, with white space or the end behind them; a single line end between visible characters. Both start a piece of their own.
BORDER = re.compile(f"{MARK}(?<={LETTER}{MARK}){MARKS}(?=[ \n]|\\Z)")
LINE = re.compile(f"\n(?<=[^{BLANK}]\n)(?=[^{BLANK}])")


def pieces(text: str) -> str:
    """The text cut before spaces."""
    return CUT.sub(f"{PART} ", text) if ODD.search(text) else text.replace(" ", f"{PART} ")


def blank_pieces(text: str) -> str:
    """For tokenizers that drop white space: cut at every space and line end, without them."""
    return text.replace("\n", PART).replace(" ", PART)


def lowered_pieces(text: str) -> str:
    """The same for tokenizers that lower letters as well: done at once where whole-text and letter-by-letter lowering agree."""
    plain = text.isascii() or (unicodedata.is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text)
    return blank_pieces(text.lower() if plain else text)


class Memory:
    """What ``make`` returns for keys, asked for many at a time."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], size: int):
        self.make, self.size, self.known, self.misses = make, size, {}, 0

    def of(self, keys: list[str]) -> list[bytes]:
        known = self.known
        if not self.size:
            new = list(dict.fromkeys(keys))
            made = self.make(new)
            return made if len(new) == len(keys) else list(map(dict(zip(new, made)).__getitem__, keys))
        out = list(map(known.get, keys))
        missing = [i for i, found in enumerate(out) if found is None]
        if not missing:
            return out
        new = list({keys[i] for i in missing})
        made = dict(zip(new, self.make(new)))
        for i in missing:
            out[i] = made[keys[i]]
        self.misses += len(new)
        if self.misses > FORGETS:
            known.clear()
            self.misses = 0
        if len(known) < self.size:
            known.update((k, v) for k, v in made.items() if len(k) <= LONGEST)
        return out


class Encoder:
    """``encode_words`` turns words (what a splitting pattern finds) into packed 32-bit ids.

    Strings in ``marks`` are ids of their own wherever they stand; what lies between them is encoded as a text of its own.
    """

    def __init__(
        self, encode_words: Callable[[list[str]], list[bytes]], find, prepare=None, drops_blanks: Callable[[str], str] | None = None,
        marks: dict[str, int] | None = None,
    ):
        self.find, self.prepare = find, prepare
        self.cut, self.space = (drops_blanks, "") if drops_blanks else (pieces, " ")
        self.marks = {m: array("I", [i]).tobytes() for m, i in (marks or {}).items()}
        self.marked = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")")
        # Where the pattern cuts plain pieces at the same places, it is not run on them.
        lines = [] if drops_blanks else ["\n"]
        self.plain = PLAIN[self.space].match if find(self.space + "Ab.,\nCd$") == [self.space + "Ab", ".,", *lines, "Cd", "$"] else None
        # There nearly every piece is one word: one memory for both.
        self.words = Memory(encode_words, 0 if self.plain else WORDS)
        self.pieces = Memory(self._whole, PIECES + WORDS if self.plain else PIECES)

    def _parted(self, text: str) -> str:
        if self.plain:
            text = BORDER.sub(f"{PART}\\g<0>", text)
            if self.space:
                text = LINE.sub(f"{PART}\n{PART}", text)
        return self.cut(text)

    def _found(self, text: str) -> list[str]:
        if self.plain and (m := self.plain(text)):
            return [text] if m.end(1) == len(text) else [g for g in m.groups() if g]
        return self.find(text)

    def _whole(self, texts: list[str]) -> list[bytes]:
        # Many small lists and no cycles: Python's search for cycles would go through all of them again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._joined(texts)
        finally:
            if collecting:
                gc.enable()

    def _joined(self, texts: list[str]) -> list[bytes]:
        if self.prepare is not None:
            texts = [self.prepare(t) for t in texts]
        found = [self._found(t) for t in texts]
        ids = self.words.of(list(chain.from_iterable(found)))
        out, at = [], 0
        for f in found:
            n = len(f)
            out.append(ids[at] if n == 1 else b"".join(ids[at : at + n]))
            at += n
        return out

    def _odd(self, text: str) -> bytes:
        if any(m in text for m in self.marks):
            return b"".join(self.marks[p] if j % 2 else next(self.encode([p])) for j, p in enumerate(self.marked.split(text)))
        return self._whole([text])[0]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and chars < STEP_CHARS:
                chars += len(texts[end])
                end += 1
            step = texts[start:end]
            odd = {i for i, t in enumerate(step) if PART in t or any(m in t for m in self.marks)}
            parts = pc.split_pattern(pa.array(["" if i in odd else self._parted(t) for i, t in enumerate(step)], pa.large_string()), PART)
            distinct = parts.flatten().dictionary_encode()
            keys = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()  # ten times as fast as to_pylist
            ids = pa.array(self.pieces.of(keys), pa.large_binary()).take(distinct.indices)
            _, places, data = ids.buffers()
            ends = np.frombuffer(places, dtype=np.int64)[parts.offsets.to_numpy()].tolist()
            data = memoryview(b"" if data is None else data)
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                yield self._odd(step[i]) if i in odd else data[a:b].tobytes()
            start = end


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in files of byte-level vocabularies: itself if visible, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def library_encoder(path: str, special: bool = True) -> Encoder:
    """For a file of the tokenizers library whose splitting is one pattern.

    The file's splitting pattern is applied here, its normalizer and its merges by the library. Strings of its special tokens
    inside texts get those ids, as the library's plain call gives them; without ``special`` they are ordinary text
    (the library's ``encode_special_tokens``), which keeps texts from putting in control ids.
    """

    def build():
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        normalizer = tokenizer.normalizer
        file = json.load(open(path, encoding="utf-8"))
        said, added = file["pre_tokenizer"], file["added_tokens"]
        if any(not t["special"] or t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens of other kinds than plain special ones")
        steps = said.get("pretokenizers", [said])
        if [s["type"] for s in steps] == ["ByteLevel"] and not steps[0]["add_prefix_space"]:
            pattern = public_tokenizers.PATTERN
        elif [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and not steps[1]["use_regex"]:
            pattern = steps[0]["pattern"]["Regex"]
        else:
            raise ValueError(f"{path} splits texts by other rules than one pattern")
        merges = Tokenizer(tokenizer.model)  # the bare merges, for words that are split and spelled in byte letters already
        letters = byte_letters()

        suffix = file["model"].get("end_of_word_suffix") or ""
        width = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)  # byte letters of each token
        for token, number in file["model"]["vocab"].items():
            width[number] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)

        def encode_words(words: list[str]) -> list[bytes]:
            out = []
            for i in range(0, len(words), 20_000):
                spelled = [w.encode().decode("latin-1").translate(letters) for w in words[i : i + 20_000]]
                if spelled:
                    ids = merges.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)[0].ids
                    # Every letter is in one token: where the letters of a word end, its tokens do.
                    held = np.cumsum(width[ids])
                    sizes = np.cumsum([len(w) for w in spelled])
                    if not len(held) or held[-1] != sizes[-1]:
                        raise ValueError(f"{path} leaves out letters")
                    ends = (4 * (np.searchsorted(held, sizes) + 1)).tolist()
                    ids = array("I", ids).tobytes()
                    out += [ids[a:b] for a, b in zip([0, *ends], ends)]
            return out

        prepare = drops = None
        if normalizer is not None:
            # A lowered text of these needs no more: none of them is composed with its neighbours.
            simple = re.compile("[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*\\Z").match

            def prepare(piece):
                return piece.lower() if simple(piece) and lowers else normalizer.normalize_str(piece)

            lowers = normalizer.normalize_str("Ab Z") == "ab z"
            drops = lowered_pieces if lowers else blank_pieces
        marks = {t["content"]: t["id"] for t in added} if special else None
        return Encoder(encode_words, regex.compile(pattern).findall, prepare, drops, marks)

    return in_worker(("tokenizer", path, special), build)
