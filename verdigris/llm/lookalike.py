"""One consistent form for texts that look alike but are stored differently.

Pairs of look-alike strings come from Unicode's own decompositions (full and half width, joined forms, numerals made of
letters), from its blanks and default-ignorable characters, and from lists of letters of other scripts. Letters are
listed if a common font without serifs draws them with the very outline of another letter. Union-find over
these strings makes the classes transitive. Each class is written as its most frequent member in the corpus,
and a multi-pattern automaton rewrites texts greedily, longest match first, in decomposed form, so that
accents of look-alike letters meet too. Case, accents, digits, marks, words and line breaks stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.skew import join_by_key
from verdigris.session import bounded, materialise

#: Letters of other scripts (and small capitals) drawn like a Latin letter, by that letter.
DRAWN_ALIKE = {
    "a": "а", "b": "Ꮟ", "c": "сϲⲥᴄ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іᎥ", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօⲟᴏ", "p": "рρⲣ", "q": "ԛ", "s": "ѕꜱ", "u": "ս", "v": "ѵνᴠ", "w": "ԝᴡ", "x": "х", "y": "у", "z": "ᴢ",
    "A": "АΑꓮᎪ", "B": "ВΒꓐᏴⲂ", "C": "СϹꓚᏟⲤ", "D": "ꓓᎠᗞ", "E": "ЕΕꓰᎬⴹ", "F": "Ϝꓝ", "G": "ԌꓖᏀ", "H": "НΗꓧᎻⲎᕼ", "I": "ІΙӀꓲⲒⵏ", "J": "ЈͿᎫ", "K": "КΚꓗᏦⲔ", "L": "ԼꓡᏞᒪ", "M": "МΜꓟᎷⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ",
    "P": "РΡꓑᏢⲢ", "Q": "Ԛ", "R": "ꓣᎡ", "S": "ЅՏꓢᏚ", "T": "ТΤꓔᎢⲦ", "U": "Սꓴᑌ", "V": "ѴꓦᏙᐯⴸ", "W": "ԜꓪᎳ", "X": "ХΧꓫⲬⵝ", "Y": "ΥҮꓬ", "Z": "ΖꓜᏃ",
}
#: Letters drawn like each other, none of them like a letter above.
TWINS = ("ÆӔ", "æӕ", "ÐĐƉ", "ÞϷ", "ƂБ", "ƏӘ", "əǝә", "ƐԐ", "ɛε", "ƖꙆ", "ɩꙇ", "ƧꙄ", "ƨꙅ", "ƩΣ", "ƷӠ", "ʒӡ", "ɅΛ", "ʌᴧ", "ɵө", "ʙв", "ʜн", "ΠП", "δẟ", "ϴѲӨ", "ЧꞍ", "лᴫ", "мᴍ", "тᴛ", "ᴘᴩ", "ꚘꝎ", "ꚙꝏ", "µμ")
#: Kinds of hyphens drawn as one stroke of hyphen length.
HYPHENS = "-‐‑﹣－"
#: Tags of decompositions that change only width, joining or breaking.
PLAIN_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Format characters that are drawn: signs that enclose or precede numbers.
DRAWN_FORMATS = set("؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd")


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, item: str) -> str:
        root = self.parent.setdefault(item, item)
        while root != self.parent[root]:
            root = self.parent[root]
        while self.parent[item] != root:
            self.parent[item], item = root, self.parent[item]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        by_root: dict[str, list[str]] = {}
        for item in self.parent:
            by_root.setdefault(self.find(item), []).append(item)
        return sorted(sorted(v) for v in by_root.values() if len(v) > 1)


def _is_joined(char: str, plain: str) -> bool:
    return len(plain) > 1 and unicodedata.category(char) in ("Ll", "Lu", "Lt", "Lo") and all(c.isalpha() or unicodedata.combining(c) for c in plain)


def _is_letter_numeral(char: str, plain: str) -> bool:
    return unicodedata.category(char) == "Nl" and plain.isascii() and plain.isalpha()


def _is_plain_sans(char: str) -> bool:
    """Mathematical letters without serifs that are neither bold nor slanted."""
    return re.fullmatch("MATHEMATICAL SANS-SERIF (CAPITAL|SMALL) .", unicodedata.name(char, "")) is not None


def _is_invisible(char: str) -> bool:
    point = ord(char)
    ignorable = point in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5) or 0x180B <= point <= 0x180F or 0xFE00 <= point <= 0xFE0F or 0xE0000 <= point <= 0xE0FFF
    return ignorable or (unicodedata.category(char) == "Cf" and char not in DRAWN_FORMATS)


@lru_cache(1)
def look_alike_pairs() -> tuple[tuple[str, str], ...]:
    """Pairs of strings in decomposed form that look alike; an empty string stands for nothing visible."""
    pairs = [("\r\n", "\n")]
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if 0xD800 <= point <= 0xDFFF or not (category := unicodedata.category(char)) or category == "Cn":
            continue
        own = unicodedata.normalize("NFD", char)
        if _is_invisible(char):
            pairs.append((own, ""))
        elif category == "Zs" and point != 0x1680 or char == "\t":
            pairs.append((own, " "))
        else:
            tag, _, points = unicodedata.decomposition(char).partition(" ")
            if tag in PLAIN_TAGS or tag in ("<compat>", "<font>"):
                plain = "".join(chr(int(p, 16)) for p in points.split())
                if tag in PLAIN_TAGS or tag == "<compat>" and (_is_joined(char, plain) or _is_letter_numeral(char, plain)) or tag == "<font>" and _is_plain_sans(char):
                    pairs.append((own, unicodedata.normalize("NFD", plain)))
    pairs += [(letter, other) for letter, others in DRAWN_ALIKE.items() for other in others]
    pairs += [(first, other) for first, *others in TWINS for other in others]
    return tuple(pairs + [(h, "-") for h in HYPHENS[1:]])


@lru_cache(1)
def look_alike_classes() -> tuple[tuple[str, ...], ...]:
    """The transitive classes."""
    sets = UnionFind()
    for a, b in look_alike_pairs():
        sets.union(a, b)
    return tuple(tuple(c) for c in sets.classes())


def _ranges(chars: set[str]) -> str:
    """A character class body with neighbours joined into ranges, which keeps matching fast beyond the BMP."""
    out, points = [], sorted(map(ord, chars))
    for point in points:
        if out and out[-1][1] == point - 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in out)


class Rewriter:
    """Rewrites every member of a class into the class's representative.

    ``frequencies`` gives how often each member occurs; of equally frequent members the smallest code points win,
    so without frequencies the Latin and plain forms do. Only members of the greatest length in their
    class can be chosen: a joined letter that stood for its parts would hide the overlaps of neighbouring
    joins. A class with the empty string is always removed.
    """

    def __init__(self, frequencies: dict[str, int] | None = None):
        counts = frequencies or {}
        chosen: dict[str, str] = {}
        for members in look_alike_classes():
            longest = max(map(len, members))
            best = "" if "" in members else min((m for m in members if len(m) == longest), key=lambda m: (-counts.get(m, 0), m))
            if "\n" in members:
                best = "\n"
            chosen |= {m: best for m in members}
        self.patterns = {}
        for member, best in chosen.items():
            target = best if best in ("", "\n") else "".join(chosen.get(c, c) if len(best) > 1 else c for c in best)
            if member != target and member:
                self.patterns[member] = target
        self.ascii_safe = not any(p.isascii() for p in self.patterns if p not in ("\t", "\r\n"))
        # rewriting can only touch runs of these characters; the automaton reads nothing else
        self._runs = re.compile(f"[{_ranges(set(''.join(self.patterns)))}]+")
        self._automaton, self._known = None, {}

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None, "_known": {}}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for pattern, target in self.patterns.items():
                self._automaton.add_word(pattern, (len(pattern), target))
            self._automaton.make_automaton()
        return self._automaton

    def __call__(self, text: str) -> str:
        """The form of ``text``; equal for texts that look alike. The empty text stays empty."""
        if self.ascii_safe and text.isascii() and "\t" not in text and "\r" not in text:
            return text
        text = self._runs.sub(lambda run: self._rewrite(run.group()), unicodedata.normalize("NFD", text))
        return unicodedata.normalize("NFC", text)

    def _rewrite(self, run: str) -> str:
        """Greedy rewriting of one run, the longest pattern at each place; short runs are remembered."""
        if run in self._known:
            return self._known[run]
        parts, done = [], 0
        for end, (length, target) in self.automaton.iter_long(run):
            parts += (run[done : end + 1 - length], target)
            done = end + 1
        out = "".join(parts) + run[done:]
        if len(run) < 8 and len(self._known) < 100_000:
            self._known[run] = out
        return out


@lru_cache(1)
def _counted_members() -> tuple[str, ...]:
    """The members whose frequency can decide: single characters of classes whose members are all of that length."""
    classes = [c for c in look_alike_classes() if "" not in c and "\n" not in c and max(map(len, c)) == 1]
    return tuple(sorted(m for c in classes for m in c))


def member_frequencies(df: DataFrame, text: str) -> dict[str, int]:
    """How often each member that can become a representative occurs in all texts; at most one row per such member.

    Characters are counted by table look-up, those of ASCII texts as bytes.
    """
    members = _counted_members()
    code_of = np.zeros(sys.maxunicode + 1, np.uint16)
    code_of[[ord(m) for m in members]] = np.arange(1, len(members) + 1)

    def count(batches):
        totals, ascii_totals = np.zeros(len(members) + 1, np.int64), np.zeros(256, np.int64)
        for batch in bounded(batches):
            plain, other = [], []
            for t in batch.column(0).to_pylist():
                if t:
                    (plain if t.isascii() else other).append(t)
            ascii_totals += np.bincount(np.frombuffer("".join(plain).encode(), np.uint8), minlength=256)
            joined = "".join(unicodedata.normalize("NFD", t) for t in other)
            for low in range(0, len(joined), 1 << 20):
                codes = code_of[np.frombuffer(joined[low : low + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)]
                totals += np.bincount(codes, minlength=len(totals))
        totals += np.bincount(code_of[:256], ascii_totals, len(totals)).astype(np.int64)
        found = [(m, int(n)) for m, n in zip(members, totals[1:], strict=True) if n]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["member", "n"])

    counted = df.select(F.col(f"`{text}`")).mapInArrow(count, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))
    return {r["member"]: r["n"] for r in counted.collect()}  # bounded by the number of class members


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def canonical_keys(df: DataFrame, doc_id: str, text: str, rewriter: Rewriter) -> DataFrame:
    """(doc_id, canon_key, text_key): 128-bit digests of the consistent form and of the text as stored; null texts are left out."""

    def keys(batches):
        for batch in bounded(batches):
            texts = batch.column(1).to_pylist()
            canon, stored = [], []
            for t in texts:
                own = _digest(t)
                form = rewriter(t)
                stored.append(own)
                canon.append(own if form == t else _digest(form))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(canon, pa.binary()), pa.array(stored, pa.binary())], names=["doc_id", "canon_key", "text_key"])

    rows = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`")).filter(F.col(f"`{text}`").isNotNull())
    return rows.mapInArrow(keys, "doc_id bigint, canon_key binary, text_key binary")


def consistent_text(df: DataFrame, text: str, rewriter: Rewriter, output: str = "consistent_text") -> DataFrame:
    """``df`` with the consistent form of ``text`` added; null stays null."""
    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(rewriter, na_action="ignore")

    return df.withColumn(output, rewrite(F.col(f"`{text}`")))


#: Documents of one class that meet all others of the class in one group of a join.
PAIR_BLOCK = 1024


def look_alike_documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: its class (the smallest document id in it), the class's documents and stored forms.

    ``form`` is the digest of the text as stored, equal for exact copies. Null ids and null texts are left out; a
    repeated row counts once.
    """
    rewriter = Rewriter(member_frequencies(df, text))
    keys = materialise(canonical_keys(df, doc_id, text, rewriter).filter("doc_id is not null").distinct(), "look-alike-keys")
    variants = keys.groupBy("canon_key", "text_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialise(variants.groupBy("canon_key").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_forms")), "look-alike-classes")
    return join_by_key(keys, classes, ["canon_key"]).select("doc_id", "class_id", "n_documents", "n_forms", F.col("text_key").alias("form"))


def class_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of classes: their documents of different forms, each pair once.

    Its size is the square of a class, which ``n_documents`` and ``n_forms`` tell beforehand. A large class is cut
    into blocks on one side, so that its pairs come from many tasks.
    """
    several = documents.filter("n_forms > 1").withColumn("blocks", F.ceil(F.col("n_documents") / PAIR_BLOCK).cast("int"))
    a = several.select("class_id", F.col("doc_id").alias("a"), F.col("form").alias("form_a"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    b = several.select("class_id", F.col("doc_id").alias("b"), F.col("form").alias("form_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # an id with several texts may meet itself, or another id in both directions
    met = a.join(b, ["class_id", "block"]).filter("form_a < form_b and a != b")
    return met.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def look_alike_pairs_of_documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b): documents whose texts differ as stored but have one consistent form."""
    return class_pairs(materialise(look_alike_documents(df, doc_id, text), "look-alike-documents"))
