"""Language identification: a family first, then one-versus-one SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, cuts, ship, slices, tidy

BUCKETS = 13  # bits of the hashed n-gram space
ORDERS = (2, 3, 4)
UNDETERMINED = "und"
#: Rows learned from, at most, for each language.
SAMPLE = 600
#: Languages that are learned at most; the driver holds 20 MB of sample for each.
LANGUAGES = 24
#: Families of common ISO 639-1 codes (fixed values); a code not listed belongs to the family "other".
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "iranian": "fa ku ps tg",
    "austronesian": "id jv mg mi ms su tl",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "hellenic": "el",
    "vietic": "vi",
    "tai": "lo th",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Letters stay (lower case by then), and so do all bytes beyond ASCII; the rest is a blank.
_CLASS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_MULTIPLIER = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _grams(texts: list[str]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """For each order the buckets of all n-grams, and where each text's begin and end."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    x = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum([len(r) for r in raw])
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[ends[:-1]] = True  # each text keeps the blank in front of it
    ends = np.cumsum(keep)[ends - 1]
    starts = np.concatenate([[0], ends[:-1]])
    c = x[keep].astype(np.uint32)
    buckets, bounds, h = [], [], c
    for n in range(2, max(ORDERS) + 1):
        h = (h[:-1] << np.uint32(8)) | c[n - 1 :]
        if n in ORDERS:
            buckets.append(((h * np.uint32(_MULTIPLIER[n])) >> np.uint32(32 - BUCKETS)).astype(np.int32))
            bounds.append((starts, np.maximum(ends - n + 1, starts)))
    return buckets, bounds


def gram_counts(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text how often each bucket holds one of its n-grams, whole numbers. Texts are looked at a bounded slice together."""
    size = 1 << BUCKETS
    for lo, hi in cuts(list(map(len, texts)), 256, SLICE // 4):
        buckets, bounds = _grams(texts[lo:hi])
        for i in range(hi - lo):
            spans = [(b, int(first[i]), int(last[i])) for b, (first, last) in zip(buckets, bounds, strict=True)]
            if sum(z - a for _, a, z in spans) <= SLICE:
                yield np.bincount(np.concatenate([b[a:z] for b, a, z in spans]), minlength=size)
            else:  # a long text: a slice after the other
                yield sum(np.bincount(b[k : min(z, k + SLICE)], minlength=size) for b, a, z in spans for k in range(a, z, SLICE))


def gram_sums(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over each text's n-grams; a text's row does not depend on the others."""
    out = np.zeros((len(texts), table.shape[1]))
    for row, counts in zip(out, gram_counts(texts), strict=True):
        row[:] = counts.astype(np.float64) @ table / max(1, counts.sum())
    return out


def gram_shares(text: str) -> np.ndarray:
    (counts,) = gram_counts([text])
    return (counts / max(1, counts.sum())).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (last: bias, for a last column of ones in x) of an L2-regularised squared-hinge machine; classes weigh alike.

    Accelerated full-batch gradient steps from zero: the same input gives the same weights."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    bound = 2 * float(weight @ np.einsum("ij,ij->i", x, x)) + penalty
    w = last = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        at = w + (w - last) * np.float32(k / (k + 3))
        slack = np.maximum(0, 1 - y * (x @ at))
        grad = -2 * ((weight * y * slack) @ x) + np.float32(penalty) * at
        last, w = w, at - grad / np.float32(bound)
    return w


@dataclass
class Model:
    """Columns of the table: a machine for each family against the rest, then one for each pair within a family."""

    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[int, int, int]]  # family, member, member
    table: np.ndarray
    bias: np.ndarray

    def guesses(self) -> dict[str, float]:
        """The score of each language for a text that no machine tells anything about: equal families, and pairs at one half.

        If one language alone was learned it is 1, as every score is."""
        return {n: (0.5 if len(names) > 1 else 1.0) / len(self.families) for names in self.members for n in names}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [has_letter(t) and bool(self.families) for t in texts]
        margins = np.zeros((0, 0))
        if any(known):
            margins = gram_sums([t for t, k in zip(texts, known, strict=True) if k], self.table) + self.bias
        langs, scores, at = [], [], 0
        for k in known:
            if not k:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            m, at = margins[at], at + 1
            f = np.exp(2 * (m[: len(self.families)] - m[: len(self.families)].max()))
            best = int(f.argmax())
            names, sure = self.members[best], float(f[best] / f.sum())
            votes = np.zeros((len(names), 2))
            for j, (family, a, b) in enumerate(self.pairs, len(self.families)):
                if family == best:
                    p = 1 / (1 + np.exp(-np.clip(2 * m[j], -30, 30)))
                    votes[a] += [m[j] >= 0, p]
                    votes[b] += [m[j] < 0, 1 - p]
            top = max(range(len(names)), key=lambda i: (votes[i][0], votes[i][1], -i))
            langs.append(names[top])
            scores.append(min(1.0, sure * (votes[top][1] / (len(names) - 1) if len(names) > 1 else 1.0)))
        return langs, scores


def fit(shares: np.ndarray, langs: list[str]) -> Model:
    """shares: n-gram shares and a last column of ones, a row for each of langs; it is scaled in place."""
    names = sorted(set(langs))
    family_of = {n: _FAMILY.get(n, "other") for n in names}
    families = sorted(set(family_of.values()))
    members = [[n for n in names if family_of[n] == f] for f in families]
    pairs = [(k, a, b) for k, m in enumerate(members) for a in range(len(m)) for b in range(a + 1, len(m))]
    size = 1 << BUCKETS
    if not names:
        return Model([], [], [], np.zeros((size, 0), np.float32), np.zeros(0))
    own = np.array(langs)
    # frequent n-grams vary most; dividing by the root of their share gives rarer ones a say
    scale = (3 / np.sqrt(shares[:, :size].mean(axis=0) + 1e-5)).astype(np.float32)
    x = shares  # scaled in place: the sample is the driver's largest object
    x[:, :size] *= scale
    columns = []
    if len(families) == 1:
        columns.append(np.zeros(size + 1, np.float32))
    else:
        fam = np.array([family_of[n] for n in langs])
        columns += [_svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in families]
    for k, a, b in pairs:
        rows = np.isin(own, [members[k][a], members[k][b]])
        columns.append(_svm(x[rows], np.where(own[rows] == members[k][a], 1, -1).astype(np.float32)))
    w = np.stack(columns, axis=1)
    return Model(families, members, pairs, (w[:-1] * scale[:, None]).astype(np.float64), w[-1].astype(np.float64))


def learn(docs: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> Model:
    """Fit on docs(doc_id, text, lang): at most `sample` different rows of each language, those with the least hashes of doc_id and text.
    The `most` commonest languages are learned (ties by name): a table's other values of lang are junk, or too many for one driver.

    Rows with a null lang or without a letter teach nothing; null and repeated doc_ids do not matter, rows equal in doc_id, text and lang
    teach once. Other columns may have any names. n-gram shares are counted on the executors; the sample's sparse rows
    reach the driver, and a number for each language."""
    ship(docs.sparkSession)
    draw = F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text"))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", draw.alias("d"))
    commonest = rows.groupBy("lang").agg(F.approx_count_distinct("d").alias("n"), F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "lang").limit(most)
    sizes = {r["lang"]: r["n"] for r in commonest.collect()}
    if not sizes:
        return fit(np.zeros((0, (1 << BUCKETS) + 1), np.float32), [])
    share = F.create_map(*[v for lang, n in sizes.items() for v in (F.lit(lang), F.lit((1.25 * sample + 8) / max(1, n)))])[F.col("lang")]
    place = F.pmod(F.col("d"), F.lit(1_000_003))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out = [[], [], [], []]
                for lang, text, d in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if has_letter(text):
                        s = gram_shares(text)
                        seen = np.flatnonzero(s)
                        for o, v in zip(out, (lang, d, seen, s[seen]), strict=True):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.float32()))], ["lang", "d", "at", "share"])

    drawn = rows.where(place / 1_000_003.0 < share).groupBy("lang", "d").agg(F.min("text").alias("text")).select("lang", "text", "d")
    table = drawn.mapInArrow(tidy(count), "lang string, d long, at array<int>, share array<float>").toArrow()
    own, d = table["lang"].to_pylist(), table["d"].to_pylist()
    took: dict[str, int] = {}
    order = []
    for i in sorted(range(len(own)), key=lambda i: (own[i], d[i] % 1_000_003, d[i])):
        took[own[i]] = took.get(own[i], 0) + 1
        if took[own[i]] <= sample:
            order.append(i)
    dense = np.zeros((len(order), (1 << BUCKETS) + 1), np.float32)
    dense[:, -1] = 1
    for row, i in zip(dense, order, strict=True):
        row[table["at"][i].values.to_numpy()] = table["share"][i].values.to_numpy()
    langs = [own[i] for i in order]
    del table
    return fit(dense, langs)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs, lang_pred and score, for every row of docs; only `text` is looked at.

    A null text or one without a letter, and any text if no language was learned: `und`, score 0. Equal margins: the family, then the language, that is
    named first. A long text is looked at whole, alone in its slice; repeated rows get equal results, an empty table an empty one."""
    ship(docs.sparkSession)
    fields = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                langs, scores = model.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    seen = docs.select(*keep, F.col("text").alias("_looked_at"))
    return seen.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def held_out(folds: int, left: int):
    """True for the rows that nothing may be learned from: crc32(doc_id as text) mod folds = left."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == left, F.lit(False))
