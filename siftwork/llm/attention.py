"""A small causal self-attention model over subword ids, trained and run in numpy."""

from __future__ import annotations

import numpy as np

#: Tokens that one window scores, and tokens before them that it also sees.
SCORED = 16
BEFORE = 4
WIDTH = 12
#: Coordinates that describe a subword; the model sees these and a constant.
FEATURES = 23
#: Subwords fall into so many classes, and each class into so many parts; the model predicts both in turn.
CLASSES = 24
PARTS = 24
#: What stands before an id is told apart by its class and one of so many groups of the class's parts.
GROUPS = 4
#: Frequent subwords with an input row of their own; the others use their part's.
OWN_ROWS = 2048
#: The most frequent subwords, which count as neighbours of their own.
COMMON = 128
LEARNING_RATE = 0.01
WINDOWS_A_STEP = 1024
CAP = np.float32(40.0)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over sequences that stand end to end: (place of the first scored token less one, tokens scored,
    whether nothing of the sequence stands before, sequence).

    A sequence of n tokens (the first is its start) has n - 1 to score. Window w scores the ``SCORED`` tokens
    after place w * SCORED and sees those and ``BEFORE`` more, so windows overlap in what they see and score each
    token once.
    """
    counts = -(-np.maximum(lengths - 1, 0) // SCORED)
    of = np.repeat(np.arange(len(lengths)), counts)
    first = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * SCORED
    starts = (np.cumsum(lengths) - lengths)[of]
    return starts + first, np.minimum(lengths[of] - 1 - first, SCORED), first == 0, of


class Subwords:
    """What is known of each id before training: input row, class, part, and each input row's coordinates.

    ``first`` (rows x classes) and ``second`` (rows * classes x parts) are log probabilities of what follows a
    row, from the counts of all training texts; training adds what the window says to them. ``emit`` (groups x
    ids) is the log probability of an id given its part and the group before.
    """

    def __init__(self, row: np.ndarray, of: np.ndarray, part: np.ndarray, points: np.ndarray):
        self.row, self.of, self.part = row.astype(np.int32), of.astype(np.int16), part.astype(np.int16)
        self.group = (of * GROUPS + part % GROUPS).astype(np.int32)
        self.points = np.ascontiguousarray(points, np.float32)
        self.rows = len(points)
        self.first = np.full((self.rows, CLASSES), -np.log(CLASSES), np.float32)
        self.second = np.full((self.rows * CLASSES, PARTS), -np.log(PARTS), np.float32)
        self.emit = np.zeros((CLASSES * GROUPS, len(row)), np.float32)

    def emitted(self, ids: np.ndarray) -> np.ndarray:
        """``emit`` of each id after the one before it."""
        at = np.take(self.group, ids[:-1]).astype(np.int64) * self.emit.shape[1] + ids[1:]
        return np.concatenate([np.zeros(1, np.float32), np.take(self.emit.ravel(), at)])


def _bounded(x: np.ndarray) -> np.ndarray:
    """x within ``CAP`` of 0, in place, so that its powers neither overflow nor all vanish: they are not shifted, as those of
    a trained model are small."""
    if x.size and (x.max() > CAP or x.min() < -CAP):
        np.clip(x, -CAP, CAP, out=x)
    return x


class Attention:
    """One layer: attention over the window's rows, added to what the last row alone says of the next token.

    Weights: ``q`` (features x width), ``kv`` (features x 2 width), ``near`` (a bias for each distance),
    ``first`` (width x classes) and ``second`` (classes x width x parts).
    """

    NAMES = ("q", "kv", "near", "first", "second")

    def __init__(self, subwords: Subwords, seed: int = 7):
        self.subwords, rng = subwords, np.random.default_rng(seed)
        make = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        features = subwords.points.shape[1]
        self.q, self.kv = make(0.3, features, WIDTH), make(0.3, features, 2 * WIDTH)
        self.near = np.zeros(BEFORE + SCORED, np.float32)
        self.first, self.second = make(0.03, WIDTH, CLASSES), make(0.03, CLASSES, WIDTH, PARTS)
        distance = (np.arange(SCORED)[:, None] + BEFORE) - np.arange(BEFORE + SCORED)[None, :]
        self.distance, self.hidden = np.maximum(distance, 0), distance < 0
        self._adam = None

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def set_weights(self, weights: list[np.ndarray]) -> None:
        for n, w in zip(self.NAMES, weights, strict=True):
            setattr(self, n, np.array(w, np.float32))
        self._adam = None

    def _attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Powers of the attention of each scored place to all it may see, their sums, and the mean of the values.

        What lies beyond the end of a sequence is seen by no token that counts.
        """
        score = _bounded(np.matmul(q, k.transpose(0, 2, 1)))
        score += np.where(self.hidden, np.float32(-1e9), np.take(self.near, self.distance))
        score[first, :, :BEFORE] = -1e9
        np.exp(score, out=score)
        total = np.einsum("bij->bi", score)[:, :, None]
        mean = np.matmul(score, v)
        mean /= total
        return score, total, mean.reshape(-1, WIDTH)

    def _head(self, u: np.ndarray, last: np.ndarray, of: np.ndarray, part: np.ndarray, weight: np.ndarray | None = None):
        """Natural log probability of each target; with ``weight`` also the slopes of the weighted loss."""
        n, w = len(u), self.subwords
        at = np.arange(n)
        # no product is larger than the lengths of what is multiplied, so most batches need no other bound
        longest = max(np.einsum("wc,wc->c", self.first, self.first).max(), np.einsum("cwp,cwp->cp", self.second, self.second).max())
        bounded = _bounded if n and np.einsum("nw,nw->n", u, u).max() * longest > CAP**2 else np.asarray
        one = np.take(w.first, last, 0)
        one += bounded(u @ self.first)
        chosen = np.take(one.ravel(), at * CLASSES + of)
        np.exp(one, out=one)
        total = one @ np.ones(CLASSES, np.float32)
        log_prob = chosen - np.log(total)
        # targets of one class stand together, so each class is one product
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(np.take(of, order), np.arange(CLASSES + 1))
        parts_of, u_of = np.take(part, order), np.take(u, order, 0)
        two = np.take(w.second, np.take(last * CLASSES + of, order), 0)
        runs = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if a < b]
        for c, run in runs:
            two[run] += bounded(u_of[run] @ self.second[c])
        chosen = np.take(two.ravel(), at * PARTS + parts_of)
        np.exp(two, out=two)
        total_two = two @ np.ones(PARTS, np.float32)
        log_prob[order] += chosen - np.log(total_two)
        if weight is None:
            return log_prob
        one *= (weight / total)[:, None]
        one.ravel()[at * CLASSES + of] -= weight
        of_order = np.take(weight, order)
        two *= (of_order / total_two)[:, None]
        two.ravel()[at * PARTS + parts_of] -= of_order
        d_second, d_two = np.zeros_like(self.second), np.empty_like(u)
        for c, run in runs:
            d_second[c] = u_of[run].T @ two[run]
            d_two[run] = two[run] @ self.second[c].T
        d_u = one @ np.ascontiguousarray(self.first.T)
        back = np.empty(n, np.int64)
        back[order] = at
        d_u += np.take(d_two, back, 0)
        return log_prob, d_u, u.T @ one, d_second

    def step(self, rows: np.ndarray, first: np.ndarray, of: np.ndarray, part: np.ndarray, valid: np.ndarray, rate: float) -> float:
        """One Adam step on a batch of windows; returns the mean loss."""
        b, seen = rows.shape
        points, seen_rows = self.subwords.points, rows.ravel()
        kv = np.take(points @ self.kv, seen_rows, 0).reshape(b, seen, 2 * WIDTH)
        q = np.take(points @ self.q, rows[:, BEFORE:], 0)
        k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
        a, total, u = self._attend(q, k, v, first)
        weight = valid.ravel() / np.float32(max(1, valid.sum()))
        log_prob, d_u, d_first, d_second = self._head(u, rows[:, BEFORE:].ravel(), of.ravel(), part.ravel(), weight)
        # the powers are not divided by their sums, so the slopes are
        d_u /= total.reshape(-1, 1)
        mean = np.einsum("nw,nw->n", d_u, u).reshape(b, SCORED, 1)
        d_u = d_u.reshape(b, SCORED, WIDTH)
        d_kv = np.empty_like(kv)
        d_kv[:, :, WIDTH:] = np.matmul(a.transpose(0, 2, 1), d_u)
        d_s = np.matmul(d_u, v.transpose(0, 2, 1))
        d_s -= mean
        d_s *= a
        d_kv[:, :, :WIDTH] = np.matmul(d_s.transpose(0, 2, 1), q)
        d_near = np.bincount(self.distance.ravel(), np.einsum("bij->ij", d_s).ravel(), len(self.near)).astype(np.float32)
        x, d_q = np.take(points, seen_rows, 0), np.zeros((b, seen, WIDTH), np.float32)
        d_q[:, BEFORE:] = np.matmul(d_s, k)
        self._update([x.T @ d_q.reshape(-1, WIDTH), x.T @ d_kv.reshape(-1, 2 * WIDTH), d_near, d_first, d_second], rate)
        return -float(log_prob @ weight)

    def _update(self, slopes: list[np.ndarray], rate: float) -> None:
        if self._adam is None:
            self._adam = [0, [np.zeros_like(w) for w in slopes], [np.zeros_like(w) for w in slopes]]
        self._adam[0] += 1
        t, first, second = self._adam
        for w, g, m, s in zip(self.weights(), slopes, first, second, strict=True):
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            w -= np.float32(rate) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(s / np.float32(1 - 0.99**t)) + np.float32(1e-8))

    def _batches(self, ids: np.ndarray, starts: np.ndarray, at_once: int):
        """(run of windows, rows seen, classes and parts of what they score) of windows that start at ``starts``."""
        padded = lambda x, before=0: np.concatenate([np.zeros(before, x.dtype), x, np.zeros(SCORED + 1, x.dtype)])
        w = self.subwords
        rows, of, part = padded(np.take(w.row, ids), BEFORE), padded(np.take(w.of, ids)), padded(np.take(w.part, ids))
        seen, scored = np.arange(BEFORE + SCORED), np.arange(1, SCORED + 1)
        for lo in range(0, len(starts), at_once):
            at = starts[lo : lo + at_once, None]
            target = at + scored
            yield slice(lo, lo + at_once), np.take(rows, at + seen), np.take(of, target), np.take(part, target)

    def train(
        self, ids: np.ndarray, lengths: np.ndarray, rate: float = LEARNING_RATE, passes: int = 1, seed: int = 1, falling: bool = True,
        a_step: int | None = None,
    ) -> float:
        """Passes over sequences in a shuffled order of windows, ``a_step`` of them in one step; returns the last loss."""
        a_step = a_step or WINDOWS_A_STEP
        starts, sizes, first, _ = windows(lengths)
        rng, loss, done = np.random.default_rng(seed), 0.0, 0
        total = max(1, passes * -(-len(starts) // a_step))
        for _ in range(passes):
            order = rng.permutation(len(starts))
            for run, rows, of, part in self._batches(ids, starts[order], a_step):
                pick = order[run]
                valid = (np.arange(SCORED) < sizes[pick][:, None]).astype(np.float32)
                loss = self.step(rows, first[pick], of, part, valid, rate * (1 - 0.9 * done / total) if falling else rate)
                done += 1
        return loss

    def score(self, ids: np.ndarray, lengths: np.ndarray, at_once: int = 1024) -> np.ndarray:
        """Natural log probability of each sequence after its start."""
        starts, sizes, first, of_window = windows(lengths)
        points, totals = self.subwords.points, np.zeros(len(starts))
        kv = points @ self.kv
        q, k, v = points @ self.q, np.ascontiguousarray(kv[:, :WIDTH]), np.ascontiguousarray(kv[:, WIDTH:])
        emitted = np.concatenate([self.subwords.emitted(ids), np.zeros(SCORED + 1, np.float32)])
        scored = np.arange(1, SCORED + 1)
        for run, rows, of, part in self._batches(ids, starts, at_once):
            last = rows[:, BEFORE:]
            _, _, u = self._attend(np.take(q, last, 0), np.take(k, rows, 0), np.take(v, rows, 0), first[run])
            found = self._head(u, last.ravel(), of.ravel(), part.ravel()).reshape(-1, SCORED)
            found += np.take(emitted, starts[run, None] + scored)
            totals[run] = np.einsum("ij,ij->i", found, (np.arange(SCORED) < sizes[run][:, None]).astype(np.float32))
        return np.bincount(of_window, totals, len(lengths))


def neighbour_keys(ids: np.ndarray, lengths: np.ndarray, column: np.ndarray) -> np.ndarray:
    """id * 2 (COMMON + 1) + side for the neighbours of each id in its sequence: the column of the one before, and
    that of the one after + COMMON + 1.

    ``column`` numbers the ``COMMON`` most frequent ids; others count together as ``COMMON``.
    """
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths)[:-1]] = False  # first of a sequence, but for the very first
    left, right = ids[:-1][inner[1:]].astype(np.int64), ids[1:][inner[1:]].astype(np.int64)
    wide = 2 * (COMMON + 1)
    return np.concatenate([right * wide + np.take(column, left), left * wide + COMMON + 1 + np.take(column, right)])


def _clusters(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means, with weights."""
    k, rng = min(k, len(points)), np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False, p=weight / weight.sum())]
    near = np.zeros(len(points), np.int64)
    for _ in range(15):
        near = np.argmin((centres**2).sum(1)[None] - 2 * points @ centres.T, 1)
        total = np.bincount(near, weight, k)
        sums = np.stack([np.bincount(near, weight * points[:, j], k) for j in range(points.shape[1])], 1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total[:, None], 1e-9), centres)
    return near


def describe_subwords(points: np.ndarray, counts: np.ndarray) -> Subwords:
    """Classes and parts of all ids (ids whose neighbours are alike share them), and their input rows.

    Ids that the texts lack form a part of their own. A row's coordinates are the mean of its ids', scaled, and a
    constant.
    """
    present = np.flatnonzero(counts > 0)
    weight = counts.astype(float)
    of, part = np.full(len(counts), CLASSES - 1), np.full(len(counts), PARTS - 1)
    of[present] = _clusters(points[present], weight[present], CLASSES - 1, 3)
    for c in range(CLASSES - 1):
        own = present[of[present] == c]
        if len(own):
            part[own] = _clusters(points[own], weight[own], PARTS, 4)
    row = of * PARTS + part
    often = present[np.argsort(-counts[present], kind="stable")[:OWN_ROWS]]
    row[often] = CLASSES * PARTS + np.arange(len(often))
    rows = CLASSES * PARTS + OWN_ROWS
    total = np.bincount(row, weight, rows)
    mean = np.stack([np.bincount(row, weight * p, rows) for p in points.T], 1) / np.maximum(total, 1)[:, None]
    scale = np.sqrt((mean**2 * total[:, None]).sum(0) / max(1.0, total.sum()))
    described = np.concatenate([mean / np.maximum(scale, 1e-9), np.ones((rows, 1))], 1)
    return Subwords(row, of, part, described)


def following(subwords: Subwords, followed: np.ndarray, emissions: np.ndarray, prior: float = 20.0, emit_prior: float = 5.0) -> None:
    """Set the log probabilities of ``subwords`` from the counts of all training texts.

    ``followed`` counts (row, part that follows), ``emissions`` (group before, id). A row's share counts for
    ``prior`` tokens beside that of its part, and a part's beside that of all; an id's share in its part for
    ``emit_prior`` beside the counts after one group. So nothing is impossible.
    """
    parts = CLASSES * PARTS
    part_of = subwords.of.astype(np.int64) * PARTS + subwords.part
    of_row = np.minimum(np.arange(subwords.rows), parts - 1)  # rows that no id uses say nothing
    of_row[subwords.row] = part_of
    by_part = np.zeros((parts, parts))
    np.add.at(by_part, of_row, followed)
    everywhere = by_part.sum(0) + 0.5
    by_part = (by_part + prior * everywhere / everywhere.sum()) / (by_part.sum(1, keepdims=True) + prior)
    share = (followed + prior * by_part[of_row]) / (followed.sum(1, keepdims=True) + prior)
    share = share.reshape(subwords.rows, CLASSES, PARTS)
    of_class = share.sum(2)
    subwords.first = np.log(of_class).astype(np.float32)
    subwords.second = np.log(share / of_class[:, :, None]).astype(np.float32).reshape(-1, PARTS)
    alone = emissions.sum(0) + 0.1
    in_part = alone / np.bincount(part_of, alone, parts)[part_of]
    for c in range(len(emissions)):
        whole = np.bincount(part_of, emissions[c], parts)[part_of]
        subwords.emit[c] = np.log((emissions[c] + emit_prior * in_part) / (whole + emit_prior))
