"""Quality rules as weak supervision: rules vote or abstain, EM estimates what they say of good texts and of texts with
each fault, and the posterior probability of a good text decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import append_from_text, materialize

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
#: Bytes to delete so that what stays are: capitals; one byte for each letter; words that have a letter.
NO_CAPITAL = bytes(x for x in range(256) if not 65 <= x <= 90)
NO_LETTER = bytes(x for x in range(256) if not (chr(x).isascii() and chr(x).isalpha() or x >= 192))
NO_WORD = bytes(x for x in range(128) if not chr(x).isalpha() and chr(x) not in BLANKS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_alpha_words", "n_distinct_words")
WINDOW = 5


def repeated_window_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in the list, the first one included."""
    n = len(words) - window + 1
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
    if n < 2 or len(known) == len(words):
        return 0
    code, size = ids[:n], len(known)
    for k in range(1, window):  # exact: codes are renumbered before they would leave 62 bits
        if size * len(known) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            size = n
        code = code * len(known) + ids[k : n + k]
        size *= len(known)
    ordered = np.sort(code)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(code, again))
    edges = np.zeros(len(words) + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; all 0 for a null one. Lines without a word count neither as lines nor as repeated ones.

    Capitals are A-Z; letters are A-Z, a-z and whatever is not ASCII."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at the blank and TAB to CR, as WORD has it
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_window_words(words), len(lines),
        len(raw.translate(None, NO_CAPITAL)), len(raw.translate(None, NO_LETTER)), len(raw.translate(None, NO_WORD).split()), len(set(words)),
    )


def _counter():
    import pyarrow as pa

    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    def make(texts: list[str | None]) -> pa.Array:
        rows = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], fields=list(kind))

    return make


def document_counts(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the carried columns and COUNTS (long) of every document, row by row."""
    held = append_from_text(docs.select(F.col("doc_id").cast("long"), *carried, "text"), "_counts", f"struct<{', '.join(f'{c}: long' for c in COUNTS)}>", _counter)
    return held.select("doc_id", *carried, "_counts.*")


#: name -> (bad, good): what makes the rule vote against and for a document; else it abstains.
RULES = {
    "length": ("n_words < 10", "n_words >= 30"),
    "word_length": ("n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)", "word_chars between 3 * n_words and 9 * n_words and n_words > 0"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words and n_words > 0"),
    "lines": ("2 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines > 1"),
    "windows": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words and n_words >= 10"),
    "capitals": ("10 * n_upper > 3 * n_letters", "10 * n_upper <= n_letters and n_letters > 0"),
    "letters": ("n_words >= 20 and 10 * n_alpha_words < 7 * n_words", "10 * n_alpha_words >= 9 * n_words and n_words > 0"),
    "variety": ("n_words >= 20 and 10 * n_distinct_words < 2 * n_words", "10 * n_distinct_words >= 3 * n_words and n_words >= 20"),
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


#: A fault that this share of its documents shows in no second rule, or less, is taken for a rule's own error.
CORROBORATED = 0.1
#: Prior on what a rule says of good texts (against, abstains, for) and its weight: some votes and a share of all rows.
TRUST, TRUST_VOTES, TRUST_SHARE = (0.01, 0.14, 0.85), 20.0, 0.05
#: Weights, in votes, of the priors of what a rule says of its own fault (and the shares there), and of other faults.
OWN, OWN_VOTES, OTHER_VOTES = (0.9, 0.05, 0.05), 20.0, 20.0


@dataclass
class Faults:
    """Classes of texts: good ones first, then one for each rule whose fault is believed (rule -1: bad in any way).

    share: of all texts by class; says: P(outcome | class) by class, rule and outcome (against, abstains, for)."""

    share: np.ndarray
    says: np.ndarray
    rules: list[int]

    def both(self, votes: np.ndarray) -> np.ndarray:
        """The logarithm of P(class and votes), a row for each row of votes."""
        seen = votes.astype(int) + 1
        return np.log(self.share) + sum(np.log(self.says[:, j, seen[:, j]]).T for j in range(votes.shape[1]))

    def logs(self, votes: np.ndarray) -> np.ndarray:
        return np.logaddexp.reduce(self.both(votes), axis=1)

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """P(class | votes)."""
        return np.exp(self.both(votes) - self.logs(votes)[:, None])

    def quality(self, votes: np.ndarray) -> np.ndarray:
        return self.classes(votes)[:, 0]


def ordered(says: np.ndarray, good: np.ndarray) -> np.ndarray:
    """A class's outcome probabilities so changed that a vote against speaks no less for the fault than an abstention, and
    that no less than a vote for: ratios to those of good texts fall, neighbours out of order being pooled. Nor does an
    abstention speak for the fault: its ratio is 1 at most, so a text without a vote against it is as good as texts are."""
    blocks = [[p, g, 1] for p, g in zip(says, good, strict=True)]
    i = 0
    while i + 1 < len(blocks):
        (p, g, n), (q, h, m) = blocks[i : i + 2]
        if p * h < q * g:
            blocks[i : i + 2] = [[p + q, g + h, n + m]]
            i = max(0, i - 1)
        else:
            i += 1
    against, silent, for_it = np.repeat([p / g for p, g, _ in blocks], [n for *_, n in blocks])
    if silent > 1:  # to abstain blames nobody
        silent, for_it = 1.0, min(1.0, for_it)
        against = (1 - silent * good[1] - for_it * good[2]) / good[0]
    return np.array([against, silent, for_it]) * good


def fitted(votes: np.ndarray, counts: np.ndarray, p: np.ndarray, own: list[int], rounds: int = 300) -> Faults:
    """Expectation-maximisation from p, the classes of each row at first; own: each bad class's rule, -1 for none."""
    seen = np.stack([votes < 0, votes == 0, votes > 0], axis=2).astype(float)
    total, was = counts.sum(), None
    weight = TRUST_VOTES + TRUST_SHARE * total
    for _ in range(rounds):
        held = p * counts[:, None]
        sizes = held.sum(axis=0)
        share = (sizes + np.r_[16.0, np.full(len(own), 4.0 / max(1, len(own)))]) / (total + (20.0 if own else 16.0))
        said = np.einsum("pk,pjo->kjo", held, seen)
        says = np.empty_like(said)
        says[0] = (said[0] + weight * np.array(TRUST)) / (sizes[0] + weight)
        for k, rule in enumerate(own, 1):
            prior = says[0] * OTHER_VOTES
            if rule >= 0:
                prior[rule] = np.array(OWN) * OWN_VOTES
            found = (said[k] + prior) / (sizes[k] + prior.sum(axis=1, keepdims=True))
            says[k] = np.array([ordered(f, g) for f, g in zip(found, says[0], strict=True)])
        model = Faults(share, says, own)
        p = model.classes(votes)
        if was is not None and np.abs(share - was).max() < 1e-10:
            break
        was = share
    return model


def by_rule(votes: np.ndarray, rules: list[int]) -> np.ndarray:
    """Each text in the faults of the rules that blame it, in equal parts; else it is good."""
    against = votes[:, rules] < 0
    return np.concatenate([~against.any(axis=1, keepdims=True), against / np.maximum(1, against.sum(axis=1, keepdims=True))], axis=1)


def estimate(votes: np.ndarray, counts: np.ndarray) -> Faults:
    """Faults of vote patterns (rows of -1, 0, 1) seen counts times.

    A bad text has one fault or another, so every rule begins with a fault of its own. Votes alone can't tell a fault that
    no other rule ever sees from a rule that is wrong about good texts; it is taken for the latter: faults of whose
    documents no more than CORROBORATED have a second vote against them are given up, the least corroborated first, and
    their rules' votes then count as errors about good texts. Where one kind of bad text, blamed by most of its votes,
    explains the patterns better for its fewer numbers (by the Bayesian information criterion), that is taken. Without
    rows the priors are returned."""
    rules = list(range(votes.shape[1]))
    while True:
        model = fitted(votes, counts, by_rule(votes, rules), rules)
        if not len(votes):
            return model
        p = model.classes(votes) * counts[:, None]
        second = (votes < 0).sum(axis=1) >= 2
        corroborated = [(p[second, k].sum() / max(1e-300, p[:, k].sum()), r) for k, r in enumerate(rules, 1)]
        worst = min(corroborated, default=(1.0, -1))
        if worst[0] > CORROBORATED:
            break
        rules = [r for r in rules if r != worst[1]]
    good = 1 / (1 + np.exp(2 * ((votes < 0).sum(axis=1) - (votes > 0).sum(axis=1))))
    other = fitted(votes, counts, np.stack([good, 1 - good], axis=1), [-1])
    size = lambda m: len(m.share) * (1 + 2 * votes.shape[1]) * math.log(counts.sum()) / 2
    return max(model, other, key=lambda m: counts @ m.logs(votes) - size(m))


def weak_supervision(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, the rules' votes, base_failed, quality (posterior probability) and kept for every document.

    Two passes: counts are written once to the shared folder; the vote patterns (3 to the power of the number of
    rules at most, however many documents) are summed by Spark, EM runs over them, and their posteriors, a row for each
    pattern, meet the documents again. kept: the base passes and the posterior is the threshold or more. A further vote
    against a text never raises its posterior. Null and empty texts have zero counts and fail the base; very long texts
    are counted whole; repeated rows stay and count as often as they are there; an empty table gives no rows. Other
    columns of docs are not read."""
    counted = materialize(document_counts(docs), "quality-counts")
    votes = [F.when(F.expr(bad), -1).when(F.expr(ok), 1).otherwise(0).alias(f"vote_{name}") for name, (bad, ok) in RULES.items()]
    voted = counted.select("*", *votes)
    names = [f"vote_{x}" for x in RULES]
    patterns = voted.groupBy(names).count().collect()
    seen = np.array([[r[n] for n in names] for r in patterns], dtype=float).reshape(-1, len(names))
    model = estimate(seen, np.array([r["count"] for r in patterns], dtype=float))
    rows = [(*map(int, v), float(q)) for v, q in zip(seen, model.quality(seen), strict=True)]
    told = docs.sparkSession.createDataFrame(rows, ", ".join([f"{n} int" for n in names] + ["quality double"]))
    out = voted.join(F.broadcast(told), names).withColumn("base_failed", F.expr(BASE_FAILED))  # a row for each pattern
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
