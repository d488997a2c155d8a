"""Document quality from labelled lines.

A linear-chain conditional random field marks each line as content or boilerplate; Viterbi decoding finds the best
marks of a text, and the share of words in content lines decides whether the document stays. Plain counts of the text
come first: texts that fail them go whatever their lines say.

Documents are labelled, their lines are not. All lines of a good document are content. Of a poor one it is only known
that it has boilerplate: its lines begin as such, and in turns the field is fitted and marks them anew, the worst line
of each staying boilerplate. What looks like the lines of good documents thus becomes content within poor ones.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillmill.llm.common import bound_batches, settle

SPACES, SYMBOLS, UPPER, DIGITS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: Fixed values of the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: What describes a line, each about from 0 to 1: shares are of its bytes or words.
FEATURES = ("bias", "symbols", "bars", "upper", "exclaimed", "digits", "equal_line", "repeated", "few_words", "long_words", "log_words")
#: The share of words in content lines that a document needs.
CONTENT_SHARE = 0.75
#: Bounds of the sample that a field is fitted on: documents, and the lines of all; documents are taken whole.
SAMPLE_DOCS, SAMPLE_LINES = 2000, 100_000
#: Longer texts are fitted as several chains, of so many lines each; decoding knows no such bound.
CHAIN = 128
#: How often the lines of poor documents are marked anew.
TURNS = 3


def _count(b: bytes, kind: bytes) -> int:
    return len(b) - len(b.translate(None, kind))


def describe(text: str | None) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The base counts of a text, FEATURES of each filled line, and the words of each."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    split = [x.split() for x in lines]
    sizes = np.array([len(x) for x in split], np.int64)
    words = [w for x in split for w in x]
    n = len(words)
    repeated = np.zeros(n, bool)
    if n > 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        _, at, times = np.unique((ids[:-2] * len(known) + ids[1:-1]) * len(known) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        for o in range(3):
            repeated[o : n - 2 + o] |= twice
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    counts = {"n_words": n, "word_chars": len(text) - _count(raw, SPACES), "n_symbols": _count(raw, SYMBOLS), "n_dup_lines": len(lines) - len(seen), "n_repeat_words": int(repeated.sum())}
    total = np.concatenate([[0], np.cumsum(repeated)])
    ends = np.cumsum(sizes)
    rows = []
    for x, k, a, b in zip(lines, sizes.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        size = len(x)
        rows.append((
            1.0, min(1.0, _count(x, SYMBOLS) / k), min(1.0, 2 * x.count(b"|") / k), _count(x, UPPER) / size, min(1.0, x.count(b"!") / k), _count(x, DIGITS) / size,
            float(seen[x] > 1), float(total[b] - total[a]) / k, float(k < 4), float(size > 12 * k), np.log1p(k) / 5))
    return counts, np.array(rows, float).reshape(-1, len(FEATURES)), sizes


@dataclass
class LineField:
    """emission: what each feature adds to the score of content over boilerplate; transition[a][b]: from label a to b, 1 is content."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """The best labels of the lines, by Viterbi; ties go to content."""
        if not len(rows):
            return np.zeros(0, np.int8)
        (t00, t01), (t10, t11) = self.transition.tolist()
        gain = (rows @ self.emission).tolist()
        bad, good, back = 0.0, gain[0], []
        for g in gain[1:]:
            to_bad, to_good = t10 >= t00 + bad - good, t11 + good >= t01 + bad
            bad, good = (good + t10 if to_bad else bad + t00), (good + t11 if to_good else bad + t01) + g
            back.append((to_bad, to_good))
        label = int(good >= bad)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1], np.int8)

    def content_share(self, rows: np.ndarray, sizes: np.ndarray) -> float:
        return float(sizes[self.decode(rows) == 1].sum() / sizes.sum()) if len(sizes) else 0.0


#: Used where there are no labels of both kinds: clean sentences are content, symbols, capitals and repeats are not.
DEFAULT = LineField(np.array([3.0, -8.0, -6.0, -8.0, -8.0, -4.0, -1.0, -4.0, -0.5, -0.5, 0.5]), np.array([[0.7, -0.7], [-0.7, 0.7]]))


@dataclass
class Chains:
    """Lines of several texts for fitting, the longest first: place[j] has where the j-th line of each chain stands that has one."""

    x: np.ndarray
    place: list[np.ndarray]
    chain: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray], longest: int = CHAIN) -> "Chains":
        """The chains, and with them the text of each line (text) and its place there."""
        cut = [(i, a, min(a + longest, len(x))) for i, x in enumerate(texts) for a in range(0, len(x), longest)]
        cut.sort(key=lambda c: c[1] - c[2])
        sizes = np.array([b - a for _, a, b in cut])
        starts = np.cumsum(sizes) - sizes
        out = cls(np.concatenate([texts[i][a:b] for i, a, b in cut]), [starts[: int((sizes > j).sum())] + j for j in range(int(sizes.max()))], np.repeat(np.arange(len(cut)), sizes))
        out.text = np.repeat([i for i, _, _ in cut], sizes)
        return out


def _marginals(score: np.ndarray, t: np.ndarray, c: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the probabilities of either label, and of each line and its next those of both; zero at the end of a chain."""
    ahead, behind = score.copy(), np.zeros_like(score)
    for before, at in zip(c.place, c.place[1:]):
        old = ahead[before[: len(at)]]
        ahead[at] += np.logaddexp(old[:, :1] + t[0], old[:, 1:] + t[1])
    for at, after in zip(c.place[-2::-1], c.place[:0:-1]):
        new = score[after] + behind[after]
        behind[at[: len(after)]] = np.logaddexp(t[:, 0] + new[:, :1], t[:, 1] + new[:, 1:])
    first = ahead[c.place[0]] + behind[c.place[0]]
    whole = np.logaddexp(first[:, 0], first[:, 1])[c.chain]
    pairs = np.zeros((len(score), 2, 2))
    on = np.flatnonzero(c.chain[1:] == c.chain[:-1])
    pairs[on] = np.exp(ahead[on, :, None] + t + (score + behind)[on + 1, None, :] - whole[on, None, None])
    return np.exp(ahead + behind - whole[:, None]), pairs


def fit_lines(c: Chains, labels: np.ndarray, weight: np.ndarray, start: LineField | None = None, steps: int = 120, rate: float = 0.2, decay: float = 1e-4, chained: bool = True) -> LineField:
    """The field that makes the labels of the lines likeliest, by gradient steps over all chains at once. labels and weight are by line, a chain's lines weigh the same. Lines stand for themselves unless chained."""
    n = c.x.shape[1]
    params = np.concatenate([start.emission, start.transition.ravel()]) if start else np.zeros(n + 4)
    seen = np.zeros((len(labels), 2, 2))
    on = np.flatnonzero(c.chain[1:] == c.chain[:-1])
    seen[on, labels[on], labels[on + 1]] = 1
    m = v = np.zeros(n + 4)
    for k in range(1, steps + 1):
        gain = c.x @ params[:-4]
        single, pair = _marginals(np.stack([np.zeros_like(gain), gain], -1), params[-4:].reshape(2, 2), c)
        grad = np.concatenate([((labels - single[:, 1]) * weight) @ c.x, chained * ((seen - pair) * weight[:, None, None]).sum(0).ravel()]) - decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return LineField(params[:-4].copy(), params[-4:].reshape(2, 2).copy())


def fit_field(texts: list[np.ndarray], good: np.ndarray, turns: int = TURNS) -> LineField:
    """The field of some documents: FEATURES of their lines, and whether each is good. Good and poor ones weigh the same in all."""
    full = [i for i, x in enumerate(texts) if len(x)]
    texts, good = [texts[i] for i in full], np.asarray(good, int)[full]
    c = Chains.of(texts)
    of_good = good[c.text] == 1
    weight = np.where(of_good, 0.5 / max(1, of_good.sum()), 0.5 / max(1, (~of_good).sum()))
    labels = of_good.astype(int)
    field = fit_lines(c, labels, weight, chained=False)  # while all lines of a document are marked alike, links between lines would say no more than that
    for _ in range(turns):
        gain = c.x @ field.emission
        single, _ = _marginals(np.stack([np.zeros_like(gain), gain], -1), field.transition, c)
        fresh = np.where(of_good, 1, (single[:, 1] >= 0.5).astype(int))
        worst = np.lexsort((single[:, 1], c.text))
        worst = worst[np.flatnonzero(np.diff(c.text[worst], prepend=-1))]
        fresh[worst[~of_good[worst]]] = 0
        if (fresh == labels).all():
            break
        labels = fresh
        field = fit_lines(c, labels, weight, field)
    return field


def sample_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> LineField:
    """A field fitted on up to sample labelled documents, half of either quality where there are as many, chosen by a hash of their id.

    Documents are taken whole, in the order of that hash, as long as all together have up to so many lines. DEFAULT if
    labels or documents of either quality are missing.
    """
    bound_batches(docs.sparkSession)
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for q in (0, 1)]
    ids = picked[0].unionByName(picked[1]).withColumn("turn", F.xxhash64("doc_id"))

    def rows(batches):
        for b in batches:
            for doc_id, quality, turn, text in zip(b["doc_id"], b["quality"], b["turn"], b["text"], strict=True):
                x = describe(text)[1].astype(np.float32)
                yield pd.DataFrame({"turn": [turn], "doc_id": [doc_id], "quality": [quality], "n": [len(x)], "x": [x.tobytes()]})

    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most sample ids
    described = settle(texts.mapInPandas(rows, "turn bigint, doc_id bigint, quality int, n bigint, x binary"))
    upto = F.sum("n").over(Window.orderBy("turn", "doc_id", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # sample rows, more only where rows repeat an id
    found = described.withColumn("upto", upto).where(F.col("upto") <= lines).orderBy("turn", "doc_id", "x").select("turn", "doc_id", "quality", "x").collect()
    xs = [np.frombuffer(bytes(x), np.float32).reshape(-1, len(FEATURES)).astype(float) for *_, x in found]
    ys = np.array([q for _, _, q, _ in found])
    full = np.array([len(x) > 0 for x in xs], bool)
    return fit_field(xs, ys) if len(ys) and len(set(ys[full].tolist())) == 2 else DEFAULT


def judge_quality(docs: DataFrame, field: LineField = DEFAULT, text: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share and kept.

    Null and empty texts have no words and fail. Texts are read whole, each row by itself, so repeated rows are judged
    alike. Blank lines have no label. A share of just content_share is enough. Columns of the names above are replaced,
    others pass through; empty tables stay empty.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    bound_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{x} bigint" for x in names) + ", content_share double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                counts, rows, sizes = describe(t)
                out.append((*counts.values(), field.content_share(rows, sizes)))
            yield pd.DataFrame(out, columns=[*names, "content_share"])

    out = docs.withColumn("__judged", judged(F.col(text)))
    out = out.withColumns({x: F.col(f"__judged.{x}") for x in (*names, "content_share")}).drop("__judged")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= content_share))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that judge_quality() does not keep go, as do null, empty and short texts; the columns of docs stay.

    Rows that repeat each other are judged alike; an empty table stays empty; columns of the operator's own names are
    replaced in the judging only. The field is fitted on docs themselves, or the default one without labels of both kinds.
    """
    from quillmill.llm.common import read

    field = sample_field(docs, read(spark, sf_dir, "labels"))
    judged = judge_quality(docs.select(F.struct(*docs.columns).alias("__doc"), F.col("text").alias("__text")), field, "__text")
    return judged.where("kept").select("__doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    from quillmill.llm.common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, sample_field(docs, read(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept")
