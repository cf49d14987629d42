"""Ordered alignment of token lists and what is built on it.

Alignment is an order-preserving full outer join of two lists. Its counts have a
native form (``functions.sequences.lcs_length``); the items need a traceback,
which runs in Arrow batches over pairs of arrays, so that no group is ever
gathered: a pair is one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions.lazy import lazy_udf, row_udf

ITEMS = "array<struct<type:string,key:string,payload_idx:int,reference_idx:int>>"
#: Tables of up to so many cells are filled at once; larger ones are divided.
_CELLS = 2048
#: Counts of a file's windows that are held at once.
_COUNTS = 500_000


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a bonus for a common prefix of up to four characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == x), None)
        if j is not None:
            free[j] = False
            left.append(x)
    if not left:
        return 0.0
    right = [y for y, f in zip(b, free, strict=True) if not f]
    m, t = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _hopeful(words: list[str], others: list[str], least: float) -> list[np.ndarray]:
    """For each of ``words`` the places in ``others`` whose Jaro-Winkler similarity may reach ``least``.

    Words cannot have more letters in common than both hold of each, and lose nothing by their order at best; the bonus for the prefix is exact.
    """
    size, length = (np.array([len(w) for w in ws], np.int64) for ws in (words, others))
    chars, code = np.unique(np.frombuffer("".join((*words, *others)).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)

    def table(n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often a word has each letter, and its first four."""
        row, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        held = np.bincount(row * len(chars) + own, minlength=len(n) * len(chars)).reshape(len(n), len(chars)).astype(np.int32)
        begin = np.full((len(n), 4), -1)
        begin[row[at < 4], at[at < 4]] = own[at < 4]
        return held, begin

    held, begin = table(size, code[: size.sum()])
    have, start = table(length, code[size.sum() :])
    out, some = [], max(1, _COUNTS // max(1, len(others) * len(chars)))
    for lo in range(0, len(words), some):  # some words at a time: tables of bounded size
        n, own = size[lo : lo + some, None], begin[lo : lo + some, None]
        common = np.minimum(held[lo : lo + some, None], have).sum(axis=2)
        jaro = np.where(n + length == 0, 1, (common / np.maximum(n, 1) + common / np.maximum(length, 1) + 1) / 3)  # empty words are equal
        same = np.logical_and.accumulate((start == own) & (own >= 0), axis=2).sum(axis=2)
        out += [np.flatnonzero(row) for row in jaro + 0.1 * same * (1 - jaro) >= least - 1e-9]
    return out


_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matcher(mode: str) -> Callable[[str, str], bool]:
    """exact, nocase (ASCII) or fuzzy:<threshold> (Jaro-Winkler of the words in lower case)."""
    if mode == "exact":
        return lambda a, b: a == b
    if mode == "nocase":
        return lambda a, b: a.translate(_ASCII) == b.translate(_ASCII)
    least = float(mode.split(":")[1])
    return lambda a, b: jaro_winkler(a.lower(), b.lower()) >= least


class Sames:
    """Which reference tokens a payload token equals, as rows of booleans over the distinct tokens."""

    def __init__(self, payload: list[str], reference: list[str], mode: str) -> None:
        fold = (lambda w: w.translate(_ASCII)) if mode == "nocase" else (lambda w: w)
        names: dict[str, int] = {}
        self.ref = np.array([names.setdefault(fold(w), len(names)) for w in reference], np.int64)
        self.pay = np.array([names.get(fold(w), -1) for w in payload], np.int64)
        self.left, self.right = self.pay.tolist(), self.ref.tolist()
        self.fuzzy = None
        if mode not in ("exact", "nocase"):
            least, distinct, words = float(mode.split(":")[1]), [y.lower() for y in names], list(dict.fromkeys(payload))
            low = [w.lower() for w in words]
            rows = {w: np.zeros(len(distinct), bool) for w in words}
            for w, x, places in zip(words, low, _hopeful(low, distinct, least), strict=True):
                rows[w][[j for j in places.tolist() if jaro_winkler(x, distinct[j]) >= least]] = True
            self.fuzzy = [rows[w] for w in payload]
        else:
            self.ahead, self.behind = _places(self.right), _places(self.right[::-1])

    def row(self, i: int, c: int, d: int) -> np.ndarray:
        return self.ref[c:d] == self.pay[i] if self.fuzzy is None else self.fuzzy[i][self.ref[c:d]]


def _places(names: list[int]) -> dict[int, int]:
    """For each name an integer whose bits are its places."""
    where: dict[int, int] = {}
    for j, y in enumerate(names):
        where[y] = where.get(y, 0) | 1 << j
    return where


def _bit_rows(sames: Sames, order, c: int, d: int, back: bool = False) -> Iterator[int]:
    """Rows of the table of longest common subsequences: zero bits are the steps of a row (see ``lcs``)."""
    where, shift = (sames.behind, len(sames.right) - d) if back else (sames.ahead, c)
    full = (1 << d - c) - 1
    row = full
    yield row
    for i in order:
        same = row & (where.get(sames.left[i], 0) >> shift)
        row = ((row + same) | (row - same)) & full
        yield row


def _costs(sames: Sames, order, c: int, d: int, back: bool = False) -> np.ndarray:
    """The last row of ``_table``; without fuzzy words from bits."""
    if sames.fuzzy is not None:
        return _table(sames, order, c, d, back)
    for row in _bit_rows(sames, order, c, d, back):
        pass
    m = d - c
    bits = np.unpackbits(np.frombuffer(row.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return len(order) + np.arange(m + 1) - 2 * np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _table(sames: Sames, order: list[int], c: int, d: int, back: bool = False, whole: bool = False):
    """Costs of the payload tokens ``order`` against each prefix of reference c to d (or each suffix, ``back``).

    A step costs 1, a pair of unlike tokens 2; along a row the costs of steps are
    a running minimum. All rows are returned if ``whole``, else the last one.
    """
    at = np.arange(d - c + 1)
    row = at.copy()
    rows = [row]
    for i in order:
        same = sames.row(i, c, d)
        cost = row + 1
        np.minimum(cost[1:], row[:-1] + 2 * ~(same[::-1] if back else same), out=cost[1:])
        row = np.minimum.accumulate(cost - at) + at
        if whole:
            rows.append(row)
    return rows if whole else row


def align(payload: list[str], reference: list[str], mode: str = "exact") -> list[tuple[str, str, int | None, int | None]]:
    """(type, key, payload index, reference index) in order; a substitution is extra_reference, then extra_payload."""
    same = matcher(mode)
    lo, hi = 0, 0
    while lo < min(len(payload), len(reference)) and same(payload[lo], reference[lo]):
        lo += 1
    while hi < min(len(payload), len(reference)) - lo and same(payload[-1 - hi], reference[-1 - hi]):
        hi += 1
    out = [("match", payload[i], i, i) for i in range(lo)]
    stack = [(lo, len(payload) - hi, lo, len(reference) - hi)]
    sames = Sames(payload, reference, mode) if lo < min(len(payload), len(reference)) - hi else None
    while stack:
        a, b, c, d = stack.pop()
        n, m = b - a, d - c
        if n == 0:
            out += [("extra_reference", reference[j], None, j) for j in range(c, d)]
        elif m == 0:
            out += [("extra_payload", payload[i], i, None) for i in range(a, b)]
        elif n == 1 or n * m <= _CELLS:
            out += _full(payload, reference, a, b, c, d, sames)
        else:
            mid = (a + b) // 2
            head = _costs(sames, range(a, mid), c, d)
            tail = _costs(sames, range(b - 1, mid - 1, -1), c, d, back=True)[::-1]
            cut = c + int(np.argmin(head + tail))
            stack += [(mid, b, cut, d), (a, mid, c, cut)]
    shift = len(payload) - len(reference)
    return out + [("match", payload[j + shift], j + shift, j) for j in range(len(reference) - hi, len(reference))]


def _full_bits(payload, reference, a, b, c, d, sames):
    """``_full`` over rows of bits: a common word more is two steps less."""
    rows = list(_bit_rows(sames, range(a, b), c, d))
    common = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    back, i, j = [], b - a, d - c
    here = common(i, j)
    while i or j:
        both = common(i - 1, j - 1) if i and j else -1
        if both == here - 1 and both >= 0 and sames.left[a + i - 1] == sames.right[c + j - 1]:
            back.append(("match", payload[a + i - 1], a + i - 1, c + j - 1))
            i, j, here = i - 1, j - 1, both
        elif both == here:
            back += [("extra_payload", payload[a + i - 1], a + i - 1, None), ("extra_reference", reference[c + j - 1], None, c + j - 1)]
            i, j = i - 1, j - 1
        elif j and (not i or common(i, j - 1) == here):
            back.append(("extra_reference", reference[c + j - 1], None, c + j - 1))
            j -= 1
        else:
            back.append(("extra_payload", payload[a + i - 1], a + i - 1, None))
            i -= 1
    return back[::-1]


def _full(payload, reference, a, b, c, d, sames):
    if sames.fuzzy is None:
        return _full_bits(payload, reference, a, b, c, d, sames)
    table = [r.tolist() for r in _table(sames, range(a, b), c, d, whole=True)]
    equal = [sames.row(i, c, d).tolist() for i in range(a, b)]
    back, i, j = [], b - a, d - c
    while i or j:
        if i and j and equal[i - 1][j - 1] and table[i][j] == table[i - 1][j - 1]:
            back.append(("match", payload[a + i - 1], a + i - 1, c + j - 1))
            i, j = i - 1, j - 1
        elif i and j and table[i][j] == table[i - 1][j - 1] + 2:
            back += [("extra_payload", payload[a + i - 1], a + i - 1, None), ("extra_reference", reference[c + j - 1], None, c + j - 1)]
            i, j = i - 1, j - 1
        elif j and (not i or table[i][j] == table[i][j - 1] + 1):
            back.append(("extra_reference", reference[c + j - 1], None, c + j - 1))
            j -= 1
        else:
            back.append(("extra_payload", payload[a + i - 1], a + i - 1, None))
            i -= 1
    return back[::-1]


def aligned(mode: str = "exact"):
    """Arrow-batched column: items of two word arrays."""
    return row_udf(ITEMS)(lambda a, b: None if a is None or b is None else align(a, b, mode))


def aligned_counts(mode: str = "exact"):
    """``counts`` of ``aligned``, where the items themselves are not wanted; also of the characters of two strings."""

    def run(a, b):
        if a is None or b is None:
            return None
        found = Counter(t for t, *_ in align(list(a), list(b), mode))
        return found["match"], found["extra_payload"], found["extra_reference"]

    return row_udf("struct<matches:bigint,extra_payload:bigint,extra_reference:bigint>")(run)


@lazy_udf("double")
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is one integer of len(b) bits."""
    where: dict[str, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        same = row & where.get(x, 0)
        row = ((row + same) | (row - same)) & full
    return len(b) - row.bit_count()


@lazy_udf("int")
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """``functions.sequences.lcs_length`` for lists of any length."""
    return pd.Series([lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def counts(items: Column) -> Column:
    """struct<matches, extra_payload, extra_reference>."""
    n = lambda t: F.size(F.filter(items, lambda x: x["type"] == t)).cast("long")
    return F.struct(n("match").alias("matches"), n("extra_payload").alias("extra_payload"), n("extra_reference").alias("extra_reference"))


_LETTER = {"match": "m", "extra_payload": "p", "extra_reference": "r"}
_SIGN = {"match": "  ", "extra_reference": "+ ", "extra_payload": "- "}


def benchmark_errors(items: list[tuple[str, str]]) -> tuple[int, int, int, list[str]]:
    """(substitutions, deletions, insertions, diff lines) of aligned (type, key) items.

    The alignment is read as a string: m(atch), p(ayload only), r(eference only)
    and n for a reference word that holds, but does not begin with, ``name``,
    which stands for a personal name and is no error. Between names, ``rp`` and
    ``pr`` are substitutions and other r and p insertions and deletions. A name
    takes a payload word along: the one right before it is no longer shown (but
    counted); failing that, the next one is neither shown nor counted.
    """
    text = "".join("n" if t == "extra_reference" and "name" in k[1:] and not k.startswith("name") else _LETTER[t] for t, k in items)
    hidden: set[int] = set()
    found = Counter()
    owed = False
    for part in re.finditer(r"([^n]*)(n?)", text):
        at = [i for i in range(part.start(1), part.end(1))]
        if owed and "p" in part[1]:
            owed = False
            hidden.add(part.start(1) + part[1].index("p"))
            at = [i for i in at if i not in hidden]
        shown = "".join(text[i] for i in at)
        pairs = len(re.findall("rp|pr", shown))
        found.update(sub=pairs, dele=shown.count("p") - pairs, ins=shown.count("r") - pairs)
        if part[2] and shown.endswith("p"):
            hidden.add(at[-1])
        elif part[2]:
            owed = True
    return found["sub"], found["dele"], found["ins"], [_SIGN[t] + k for i, (t, k) in enumerate(items) if i not in hidden]


@lazy_udf("struct<wer:double,total:int,matches:int,diff:string>")
def benchmark_wer(hyp: pd.Series, ref: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """Rate over conformed, normalised lists; ``raw`` is the length of the reference as given."""
    out = []
    for h, r, n in zip(hyp, ref, raw, strict=True):
        if r is None or h is None or not n:
            out.append((0.0, 0, 0, ""))
            continue
        sub, dele, ins, diff = benchmark_errors([(t, k) for t, k, _, _ in align(list(h), list(r))])
        wrong = sub + dele + ins
        out.append((wrong / n, int(n), max(0, int(n) - wrong), "\n".join(diff)))
    return pd.DataFrame(out, columns=["wer", "total", "matches", "diff"])


# --- comparison of a transcript with its gold ---------------------------------


def best_segment(gold: list[str], main: list[str], utts: list[int], folded: list[str] | None = None) -> tuple[int, int]:
    """The stretch of ``main`` that fits ``gold`` best: overlap, aligned matches, little waste, late end.

    Windows of about the length of ``gold`` are cut to the utterance that has most
    of their words (``utts`` never falls; ties: the first). Overlaps of all windows
    come from running counts; only windows with the largest one are aligned, those
    that could have most matches first. ``folded``: ``main`` in ASCII lower case, where it is known.
    """
    n, g = len(main), len(gold)
    spans = np.arange(max(1, g - 2), min(n, g + 2) + 1)
    if not n or not g or not len(spans):
        return 0, 0
    start = np.concatenate([np.arange(n - w + 1) for w in spans])
    end = start + np.repeat(spans, n - spans + 1)
    u = np.asarray(utts)
    begins = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    ends = np.append(begins[1:], n)
    own = np.searchsorted(begins, np.arange(n), side="right") - 1
    s, e = start, np.minimum(end, ends[own[start]])
    for k in range(1, int((own[end - 1] - own[start]).max()) + 1):
        r = np.minimum(own[start] + k, own[end - 1])
        x, y = np.maximum(start, begins[r]), np.minimum(end, ends[r])
        more = y - x > e - s
        s, e = np.where(more, x, s), np.where(more, y, e)
    s, e = np.divmod(np.unique(s * (n + 1) + e), n + 1)

    def overlap(words: list[str], want: list[str]) -> np.ndarray:
        most = Counter(want)
        names = {w: k for k, w in enumerate(most)}
        have = np.array([names.get(w, -1) for w in words], np.int64)
        held = np.unique(have[have >= 0])
        limit = np.array(list(most.values()), np.int32)[held]
        total = np.zeros(len(s), np.int64)
        step = max(1, _COUNTS // len(s))
        for k in range(0, len(held), step):  # some words at a time: tables of bounded size
            count = np.zeros((n + 1, len(held[k : k + step])), np.int32)
            np.cumsum(have[:, None] == held[k : k + step], axis=0, out=count[1:])
            total += np.minimum(count[e] - count[s], limit[k : k + step]).sum(axis=1)
        return total

    shared = overlap(main, gold)
    if not shared.max():
        return 0, 0
    low, low_gold = folded or [t.translate(_ASCII) for t in main], [t.translate(_ASCII) for t in gold]
    at = np.flatnonzero(shared == shared.max())
    bound = overlap(low, low_gold)[at]  # an alignment without case has no more matches
    best, where = None, (0, 0)
    for k in np.lexsort((-e[at], e[at] - s[at], -bound)):
        if best is not None and bound[k] < best[0]:
            break
        x, y = int(s[at[k]]), int(e[at[k]])
        if best is not None and bound[k] == best[0] and (x - y, y) <= best[1:]:
            continue  # even with all its matches it would not be better
        key = (lcs(low[x:y], low_gold), x - y, y)
        if best is None or key > best:
            best, where = key, (x, y)
    return where


def compare_file(main: pd.DataFrame, gold: pd.DataFrame, complete: bool = True) -> list[tuple]:
    """Compared tokens of a file: (unit, seq, side, main utt, gold utt, text, pos, status).

    Each gold utterance goes to the main utterance with its best segment, which is
    sought behind the segment of the gold utterance before, so that a segment is
    used once; all gold utterances of one main utterance form a unit with it. Main
    utterances without gold are units of insertions unless ``complete`` is off.
    """
    m_text, m_utt, m_pos = main["text"].tolist(), main["utt"].tolist(), main["pos"].tolist()
    folded = [t.translate(_ASCII) for t in m_text]
    owner: dict[int, list[int]] = {}
    lost, frontier = [], 0
    gold_by = {u: g for u, g in gold.groupby("utt", sort=True)}
    for u, g in gold_by.items():
        s, e = best_segment(g["text"].tolist(), m_text[frontier:], m_utt[frontier:], folded[frontier:])
        if s == e:
            lost.append(u)
        else:
            owner.setdefault(m_utt[frontier + s], []).append(u)
            frontier += e
    out, unit = [], 0
    places: dict[int, list[int]] = {}
    for i, u in enumerate(m_utt):
        places.setdefault(u, []).append(i)
    for mu, idx in places.items():
        gs = owner.get(mu, [])
        if not gs and not complete:
            continue
        golden = [(u, t, p) for u in gs for t, p in zip(gold_by[u]["text"], gold_by[u]["pos"], strict=True)]
        for seq, (t, k, p, r) in enumerate(align([m_text[i] for i in idx], [t for _, t, _ in golden], "nocase")):
            side = "both" if t == "match" else "main" if t == "extra_payload" else "gold"
            pos = m_pos[idx[p]] if p is not None else golden[r][2]
            out.append((unit, seq, side, mu if p is not None else None, golden[r][0] if r is not None else None, k, pos, t))
        unit += 1
    for u in lost:
        for seq, (t, p) in enumerate(zip(gold_by[u]["text"], gold_by[u]["pos"], strict=True)):
            out.append((unit, seq, "gold", None, u, t, p, "extra_reference"))
        unit += 1
    return out


COMPARED = "file long, unit int, seq int, side string, main_utt long, gold_utt long, text string, pos string, status string"


def compare(main: DataFrame, gold: DataFrame, complete: bool = True) -> DataFrame:
    """Compared tokens of (file, utt, seq, text, pos) tables; a file is the unit of work."""

    def run(key, m: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        m, g = (_framed(x, "utt", "seq", "text", "pos").sort_values(["utt", "seq"]) for x in (m, g))
        rows = compare_file(m, g, complete)
        out = pd.DataFrame(rows, columns=["unit", "seq", "side", "main_utt", "gold_utt", "text", "pos", "status"])
        out.insert(0, "file", key[0])
        for c in ("main_utt", "gold_utt"):
            out[c] = out[c].astype("Int64")
        return out

    return main.groupBy("file").cogroup(_apart(gold).groupBy("file")).applyInPandas(run, COMPARED)


# --- transcript differences -----------------------------------------------------


def diff_file(before: pd.DataFrame, after: pd.DataFrame) -> list[tuple]:
    """(kind, before index, after index) of two versions, in document order."""
    b, a = before["words"].tolist(), after["words"].tolist()
    was, now = ({c: df[c].tolist() for c in ("speaker", "start_ms", "end_ms")} for df in (before, after))
    items = align(a, b)
    out, k = [], 0
    while k < len(items):
        t, _, p, r = items[k]
        if t == "match":
            same_speaker = was["speaker"][r] == now["speaker"][p]
            same_time = all((pd.isna(was[c][r]) and pd.isna(now[c][p])) or was[c][r] == now[c][p] for c in ("start_ms", "end_ms"))
            out.append(("unchanged" if same_speaker and same_time else "timing_only" if same_speaker else "speaker_changed", r, p))
        elif k + 1 < len(items) and {t, items[k + 1][0]} == {"extra_payload", "extra_reference"}:
            other = items[k + 1]
            out.append(("words_changed", r if r is not None else other[3], p if p is not None else other[2]))
            k += 1
        else:
            out.append(("inserted", None, p) if t == "extra_payload" else ("deleted", r, None))
        k += 1
    last = len(a)
    return sorted(out, key=lambda d: (last if d[2] is None else d[2], -1 if d[1] is None else d[1]))


def _framed(df: pd.DataFrame, *columns: str) -> pd.DataFrame:
    """A side of a cogroup, with its columns even where it has no rows."""
    return df if set(columns) <= set(df.columns) else pd.DataFrame({c: [] for c in columns})


def _apart(df: DataFrame) -> DataFrame:
    """The same columns under new identities: both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of (file, utt, speaker, words as one string, start_ms, end_ms) tables."""

    def run(key, b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        b, a = (_framed(x, "utt", "speaker", "words", "start_ms", "end_ms").sort_values("utt").reset_index(drop=True) for x in (b, a))
        rows = diff_file(b, a)
        out = pd.DataFrame(rows, columns=["kind", "before_idx", "after_idx"])
        out.insert(0, "file", key[0])
        for c in ("before_idx", "after_idx"):
            out[c] = out[c].astype("Int64")
        return out

    return before.groupBy("file").cogroup(_apart(after).groupBy("file")).applyInPandas(run, "file long, kind string, before_idx long, after_idx long")


# --- timing recovery -----------------------------------------------------------


def unique_subsequence(words: list[str], tokens: list[str]) -> list[int] | None:
    """Where ``words`` lie in ``tokens`` as a subsequence, if there is exactly one way."""
    first, at = [], 0
    for w in words:
        while at < len(tokens) and tokens[at] != w:
            at += 1
        if at == len(tokens):
            return None
        first.append(at)
        at += 1
    last, at = [], len(tokens) - 1
    for w in reversed(words):
        while tokens[at] != w:
            at -= 1
        last.append(at)
        at -= 1
    return first if first == last[::-1] else None


def _spans(utts: list, words: list[list[str]], spoken: list[str], start: list, end: list, mode: str = "nocase") -> list[tuple]:
    """(utt, start_ms, end_ms) from token times: earliest start and latest end of the matched words.

    ``words`` and ``spoken`` are in ASCII lower case. Spans of later utterances never begin before the end of the last one given.
    """
    said = [w for ws in words for w in ws]
    owner = [u for u, ws in zip(utts, words, strict=True) for _ in ws]
    where = unique_subsequence(said, spoken)
    pairs = list(enumerate(where)) if where is not None else [(p, r) for t, _, p, r in align(said, spoken, mode) if t == "match"]
    spans: dict[int, tuple[int, int]] = {}
    for p, r in pairs:
        s, e = spans.get(owner[p], (start[r], end[r]))
        spans[owner[p]] = (min(s, start[r]), max(e, end[r]))
    out, floor = [], 0
    for u in utts:
        s, e = spans.get(u, (None, None))
        if s is not None:
            s, e = max(s, floor), max(e, floor)
            s, e = (s, e) if e > s else (None, None)
        if e is not None:
            floor = e
        out.append((u, s, e))
    return out


def recover_file(utts: pd.DataFrame, tokens: pd.DataFrame, mode: str = "nocase") -> list[tuple]:
    """``_spans`` of two tables of one file."""
    fold = lambda ws: [w.translate(_ASCII) for w in ws]
    return _spans(utts["utt"].tolist(), [fold(ws) for ws in utts["words"]], fold(tokens["text"]), tokens["start_ms"].tolist(), tokens["end_ms"].tolist(), mode)


def _overlapping_spans(utts: list, words: list[list[str]], over: list[bool], spoken: list[str], start: list, end: list, density: float) -> list[tuple]:
    """``_spans`` in two passes, where that places more utterances."""
    one = _spans(utts, words, spoken, start, end)
    if not 0 < sum(over) <= density * len(over):
        return one
    plain = [k for k, o in enumerate(over) if not o]
    main = {r[0]: r for r in _spans([utts[k] for k in plain], [words[k] for k in plain], spoken, start, end)}
    begins, ends = np.array(start, float), np.array(end, float)
    two, before = [], None
    for utt, ws, o in zip(utts, words, over, strict=True):
        if not o:
            two.append(main[utt])
            before = main[utt] if main[utt][1] is not None else before
            continue
        near = range(len(spoken)) if before is None else np.flatnonzero((ends >= before[1] - L.OVERLAP_BUFFER_MS) & (begins <= before[2] + L.OVERLAP_BUFFER_MS)).tolist()
        two += _spans([utt], [ws], [spoken[k] for k in near], [start[k] for k in near], [end[k] for k in near], f"fuzzy:{L.FUZZY_MATCH}")
    return two if sum(r[1] is not None for r in two) > sum(r[1] is not None for r in one) else one


def _recovered(utts: DataFrame, tokens: DataFrame, over: Column, density: float) -> DataFrame:
    """Spans of each file: a file is a row of two lists, so that many small files share a batch."""
    fold = lambda ws: [w.translate(_ASCII) for w in ws]

    def run(u: list[dict], t: list[dict]) -> list[tuple]:
        start, end = ([math.nan if x[c] is None else x[c] for x in t] for c in ("start_ms", "end_ms"))
        found = _overlapping_spans([x["utt"] for x in u], [fold(x["words"]) for x in u], [bool(x["over"]) for x in u], fold(x["text"] for x in t), start, end, density)
        return [(k, *(None if x is None or math.isnan(x) else int(x) for x in span)) for k, *span in found]

    said = utts.select("file", F.struct("utt", "words", over.alias("over")).alias("u"))
    heard = _apart(tokens).select("file", F.struct("seq", "text", "start_ms", "end_ms").alias("t"))
    met = said.unionByName(heard, allowMissingColumns=True).groupBy("file").agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in "ut"])
    each = met.select("file", F.explode(row_udf("array<struct<utt:bigint,start_ms:bigint,end_ms:bigint>>")(run)("u", "t")).alias("s"))
    return each.select(F.col("file").cast("long").alias("file"), "s.utt", "s.start_ms", "s.end_ms")


def recover_timing(utts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans of (file, utt, words) from timed tokens (file, seq, text, start_ms, end_ms)."""
    return _recovered(utts, tokens, F.lit(False), 0)


def recover_overlapping(utts: DataFrame, tokens: DataFrame, density: float = L.OVERLAP_DENSITY) -> DataFrame:
    """Two passes: main utterances first, overlapping ones from the tokens around their predecessor.

    Files in which more than ``density`` of the utterances overlap take one pass.
    ``utts`` has ``has_overlap``.
    """
    return _recovered(utts, tokens, F.col("has_overlap"), density)


def stitch(words: list[str], tokens: list[tuple[str, int, int]]) -> list[tuple[int, int] | None]:
    """Engine tokens put onto words: each word takes tokens while their letters continue it."""
    keep = lambda s: "".join(c for c in s.lower() if c.isalnum())
    out, at = [], 0
    for w in words:
        want, got, span = keep(w), "", None
        while at < len(tokens) and want and want.startswith(got + keep(tokens[at][0])) and got != want:
            got += keep(tokens[at][0])
            span = (tokens[at][1] if span is None else span[0], tokens[at][2])
            at += 1
        out.append(span if got == want and want else None)
    return out


@row_udf("array<struct<start_ms:bigint,end_ms:bigint>>")
def stitched(words: list[str] | None, tokens: list[dict] | None) -> list[tuple[int, int] | None] | None:
    """``stitch`` of an array of words and one of struct<text, start_ms, end_ms>."""
    return None if words is None or tokens is None else stitch(words, [(t["text"], t["start_ms"], t["end_ms"]) for t in tokens])


def time_warp(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest monotone path through a cost matrix (ties: diagonal, then up, then left)."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for i in range(n):
        for j in range(m):
            total[i + 1, j + 1] = cost[i, j] + min(total[i, j], total[i, j + 1], total[i + 1, j])
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        step = np.argmin([total[i - 1, j - 1], total[i - 1, j], total[i, j - 1]])
        i, j = (i - 1, j - 1) if step == 0 else (i - 1, j) if step == 1 else (i, j - 1)
    return path[::-1]


@lazy_udf("array<struct<i:int,j:int>>")
def warping_path(cost: pd.Series) -> pd.Series:
    return pd.Series([[{"i": int(i), "j": int(j)} for i, j in time_warp(np.stack([np.asarray(r, float) for r in m]))] if m is not None and len(m) else [] for m in cost])


def token_jumps(path: Column) -> Column:
    """Steps of a path at which the row changes (with the column where it does)."""
    first = F.transform(F.slice(path, 1, 1), lambda p: p["j"])
    later = F.zip_with(F.slice(path, F.lit(2), F.size(path)), path, lambda p, q: F.when(p["i"] != q["i"], p["j"]))
    return F.concat(first, F.filter(later, lambda j: j.isNotNull()))
