"""The main body of a page by a fitted block classifier and a minimum cut.

A linear classifier of blocks, fitted on a bounded sample of pages, gives every
block a cost for being called content and one for being called boilerplate;
these are the capacities to the two terminals.  Smoothness edges join blocks
that follow each other and blocks of one DOM segment.  The minimum cut, found by
max-flow, is the cheapest labelling of the whole page.

No page is labelled by hand and no wording is listed.  Blocks whose skeleton
(text without its links, numbers and the page's own headline) recurs on pages of
a site with different headlines are weak examples of boilerplate, running text
that does not recur is one of content.  A second fit learns the rest from the
labels of the cut.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from skein.llm.blocks import LISTING, Block, visible_blocks

#: Pages of a site, and share of its pages, on which a skeleton must recur under different headlines to be boilerplate.
RECUR_PAGES, RECUR_SHARE = 3, 0.04
#: Words from which a text that does not recur is taken for content.
RUNNING_WORDS = 8
#: Smoothness between blocks that follow each other within a segment, or across segments, and to the first of a segment.
WITHIN, ACROSS, SEGMENT = 2.0, 0.3, 1.0
#: What elements mean before any page is read: towards this the classifier is regularised.
PRIOR = {"t:h1": 2.0, "t:p": 0.5, "e:nav": -2.0, "e:footer": -2.0, "e:aside": -2.0, "e:form": -2.0, "e:dialog": -2.0, "t:button": -2.0, "t:label": -2.0, "s:above": -0.7, "s:below": -0.7, "l:4": -0.5, "w:8": 0.5, "w:16": 1.0, "s:in": 0.5}

_NUMBER = re.compile(r"\d+")
_PIECE = re.compile(r"[^\W_]+|[^\w\s]")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_TOKEN = re.compile(r"[a-z]+")


def _bucket(n: int) -> int:
    return n if n < 4 else 4 if n < 6 else 6 if n < 8 else 8 if n < 16 else 16


def describe(blocks: list[Block]) -> tuple[list[tuple], list[str], list[int], str]:
    """Of each block its place in the page (hashable), its skeleton and its segment; and the headline.

    The spine is the chain of elements down to the headline's parent (without a
    headline, to the parent with most running text).  A segment is the first
    element of a block's chain that is off the spine; 0 for blocks without one.
    """
    n = len(blocks)
    head = next((i for i in range(n) if blocks[i].chain and blocks[i].chain[-1][1] == "h1"), -1)
    title = blocks[head].text if head >= 0 else ""
    if head < 0:
        weight: dict[int, int] = {}
        for b in blocks:
            if b.text.count(" ") >= RUNNING_WORDS and b.linked * 2 < len(b.text):
                parent = b.chain[-2][0] if len(b.chain) > 1 else 0
                weight[parent] = weight.get(parent, 0) + len(b.text)
        if weight:
            best = max(weight, key=weight.get)
            head = next(i for i in range(n) if (blocks[i].chain[-2][0] if len(blocks[i].chain) > 1 else 0) == best)
    spine = blocks[head].chain[:-1] if head >= 0 else ()
    ids = {e[0] for e in spine}
    home = spine[-1][0] if spine else 0
    where = "open" if not spine or spine[-1][1] in ("html", "body") else "held"
    places, skeletons, segments = [], [], []
    for i, b in enumerate(blocks):
        k = 0
        for e in b.chain:
            if e[0] not in ids:
                break
            k += 1
        outer = b.chain[k:]
        inside = (b.chain[k - 1][0] if k else 0) == home
        side = "none" if head < 0 else "head" if i == head else ("before" if i < head else "in") if inside else ("above" if i < head else "below")
        size = len(b.text)
        share = 0 if not b.linked else 1 if b.linked * 3 < size else 2 if b.linked * 5 < size * 3 else 3 if b.linked * 10 < size * 9 else 4
        places.append((side, where, bool(title), b.chain[-1][1] if b.chain else "", tuple(e[1] for e in outer), tuple(e[2] for e in outer if e[2]), share, _bucket(b.text.count(" ") + 1)))
        skeletons.append(skeleton(b, title if i != head else ""))
        segments.append(outer[0][0] if outer else 0)
    return places, skeletons, segments, title


def skeleton(b: Block, title: str) -> str:
    """What of a text a template may hold: ``@`` for links, ``#`` for numbers, ``^`` for the headline.

    A text that is one link is its own skeleton, behind an ``@``.
    """
    t = b.plain
    if t == "@":
        return "@" + _NUMBER.sub("#", b.text.lower())
    if title and t == title:
        return "^"
    if title and title in t:
        t = t.replace(title, "^")
    return _NUMBER.sub("#", t.lower())


def place_features(place: tuple) -> list[str]:
    """Features of where a block stands and what it is."""
    side, where, titled, tag, tags, attrs, share, size = place
    spot = f"{side}/{where}/{titled}"
    path = ">".join(tags)
    out = [f"t:{tag}", f"s:{side}", f"s:{spot}", f"p:{path}", f"l:{share}", f"w:{size}", f"ps:{path}/{spot}", f"ts:{tag}/{spot}", f"tl:{tag}/{share}", f"tw:{tag}/{size}", f"sl:{spot}/{share}", f"sw:{spot}/{size}", f"tslw:{tag}/{spot}/{share}/{size}", f"d:{len(tags)}/{spot}", f"psl:{path}/{spot}/{share}"]
    out += [f"e:{t}" for t in tags]
    for a in attrs:
        for m in _ATTRIBUTE.finditer(a):
            out += [f"a:{w}" for w in _TOKEN.findall(m.group(2).lower()) if len(w) > 2]
    return out


def text_features(skel: str) -> list[str]:
    """Features of a skeleton: the whole of it, its opening and its closing pieces, and all pieces of a short one."""
    # Of a long text the opening and closing pieces lie in its outer parts.
    pieces = _PIECE.findall(skel) if len(skel) < 400 else _PIECE.findall(skel[:200]) + _PIECE.findall(skel[-200:])
    out = [f"k:{skel}" if len(skel) < 60 else f"k:{xxhash.xxh3_64_hexdigest(skel)}"]
    if pieces:
        out += [f"o:{pieces[0]}", f"c:{pieces[-1]}", f"n:{sum(x == '@' for x in pieces[:9])}/{min(len(pieces), 9)}"]
        out += [f"oo:{' '.join(pieces[:2])}", f"cc:{' '.join(pieces[-2:])}", f"ooo:{' '.join(pieces[:3])}"]
        if len(pieces) <= 12:
            out += [f"u:{x}" for x in set(pieces)]
    return out


class BlockModel:
    """Log-odds of being content, as sums of weights; looked up by place and by skeleton."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._places: dict[tuple, float] = {}
        self._texts: dict[str, float] = {}

    def score(self, place: tuple, skel: str) -> float:
        s = self._places.get(place)
        if s is None:
            if len(self._places) > 100_000:
                self._places.clear()
            s = self._places[place] = sum(self.weights.get(f, 0.0) for f in place_features(place))
        t = self._texts.get(skel)
        if t is None:
            t = sum(self.weights.get(f, 0.0) for f in text_features(skel))
            if len(skel) < 80:  # longer ones seldom come again
                if len(self._texts) > 100_000:
                    self._texts.clear()
                self._texts[skel] = t
        return self.bias + s + t


def weak_labels(pages: list[tuple[str, list[Block], list[tuple], list[str], list[int], str]]) -> list[list[int]]:
    """1 content, 0 boilerplate, -1 open, for each block of ``(site, blocks, places, skeletons, segments, headline)``.

    Recurring skeletons are boilerplate.  Headlines and running text that does
    not recur are content, and so are segments without recurring skeletons that
    stand between such blocks, beside the headline; a segment with recurring
    skeletons and without content is boilerplate as a whole.
    """
    n_pages: dict[str, set] = defaultdict(set)
    heads: dict[tuple[str, str], set] = defaultdict(set)
    for site, blocks, _, skels, _, title in pages:
        context = title or max((b.text for b in blocks), key=len, default="")
        n_pages[site].add(context)
        for s in set(skels):
            heads[site, s].add(context)
    out = []
    for site, blocks, places, skels, segments, _ in pages:
        least = max(RECUR_PAGES, RECUR_SHARE * len(n_pages[site]))
        row = []
        for b, s in zip(blocks, skels):
            n = len(heads[site, s])
            if b.chain and b.chain[-1][1] == "h1":
                row.append(1)
            elif n >= least:
                row.append(0)
            elif n <= 2 and s.count(" ") + 1 >= RUNNING_WORDS and b.linked * 2 < len(b.text):
                row.append(1)
            else:
                row.append(-1)
        mixed, held = {seg for seg, y in zip(segments, row) if not y}, {seg for seg, y in zip(segments, row) if y == 1}
        sure = [k for k, y in enumerate(row) if y == 1]
        for k in range(sure[0] + 1, sure[-1]) if sure else ():
            if row[k] < 0 and places[k][0] == "in" and segments[k] not in mixed:
                row[k] = 1
        for k, seg in enumerate(segments):
            if row[k] < 0 and seg and seg in mixed and seg not in held:
                row[k] = 0
        out.append(row)
    return out


def _logistic(r: np.ndarray, c: np.ndarray, good: np.ndarray, bad: np.ndarray, prior: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights of features and a bias; row ``r`` has the features ``c`` and was seen ``good`` and ``bad`` times."""
    keep = (good + bad > 0)[r]
    r, c = r[keep], c[keep]
    w, g1, bias, g2 = prior.copy(), np.full(len(prior), 1e-6), 0.0, 1e-6
    for _ in range(steps):
        z = bias + np.bincount(r, w[c], minlength=len(good))
        err = (good + bad) / (1 + np.exp(-np.clip(z, -30, 30))) - good
        grad = np.bincount(c, err[r], minlength=len(w)) + 0.5 * (w - prior)
        g1 += grad * grad
        w -= 0.5 * grad / np.sqrt(g1)
        gb = err.sum()
        g2 += gb * gb
        bias -= 0.3 * gb / math.sqrt(g2)
    return w, float(bias)


def fit_blocks(sample: list[tuple[str, str]], rounds: int = 2) -> BlockModel:
    """Fit on ``(site, html)`` pages; without any page the prior alone decides."""
    pages = []
    for site, page in sample:
        blocks = visible_blocks(page)
        pages.append((site, blocks, *describe(blocks)))
    labels = weak_labels(pages)
    # Blocks of one place and skeleton are one row with a weight.
    codes: dict[tuple, int] = {}
    coded = [np.array([codes.setdefault((p, s), len(codes)) for p, s in zip(places, skels)], np.int64) for _, _, places, skels, _, _ in pages]
    if not codes:
        return BlockModel(dict(PRIOR), 0.0)
    times = np.bincount(np.concatenate(coded), minlength=len(codes))
    memo: dict[tuple, list[str]] = {}
    count: Counter[str] = Counter()
    features = []
    for (p, s), n in zip(codes, times.tolist()):
        if p not in memo:
            memo[p] = place_features(p)
        f = memo[p] + text_features(s)
        features.append(f)
        for x in f:
            count[x] += n
    vocabulary = {f: k for k, f in enumerate(f for f, n in count.items() if n >= 3 or f in PRIOR)}
    prior = np.array([PRIOR.get(f, 0.0) for f in vocabulary])
    sizes, flat = [], []
    for f in features:
        known = [vocabulary[x] for x in f if x in vocabulary]
        sizes.append(len(known))
        flat += known
    r, c = np.repeat(np.arange(len(codes)), sizes), np.array(flat, np.int64)
    model = BlockModel(dict(PRIOR), 0.0)
    for turn in range(rounds):
        good, bad = np.zeros(len(codes)), np.zeros(len(codes))
        for k, code in enumerate(coded):
            y = np.array(labels[k], np.int64)
            weight = np.where(y >= 0, 1.0, 0.5)
            if turn:
                y = np.where(y >= 0, y, cut_labels(model, *pages[k][2:5]))
            np.add.at(good, code[y == 1], weight[y == 1])
            np.add.at(bad, code[y == 0], weight[y == 0])
        w, bias = _logistic(r, c, good, bad, prior)
        model = BlockModel({**PRIOR, **{f: float(w[k]) for f, k in vocabulary.items() if abs(w[k]) > 1e-4}}, bias)
    return model


def minimum_cut(score: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of the minimum cut: True on the content side.

    A terminal capacity above the sum of a node's smoothness edges decides the
    node outright (its label is the same in every minimum cut); what that
    leaves open is solved by augmenting paths.
    """
    n = len(score)
    nb: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        nb[i][j] = nb[i].get(j, 0.0) + w
        nb[j][i] = nb[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    score = score[:]
    work = list(range(n))
    while work:
        i = work.pop()
        if label[i] is not None:
            continue
        if abs(score[i]) > sum(nb[i].values()) or not nb[i]:
            label[i] = score[i] > 0
            for j, w in nb[i].items():
                score[j] += w if label[i] else -w
                del nb[j][i]
                work.append(j)
            nb[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        cap: dict[int, dict[int, float]] = {i: dict(nb[i]) for i in rest}
        cap[source], cap[sink] = {}, {}
        for i in rest:
            if score[i] > 0:
                cap[source][i] = score[i]
                cap[i].setdefault(source, 0.0)
            elif score[i] < 0:
                cap[i][sink] = -score[i]
                cap[sink].setdefault(i, 0.0)
        while True:
            came, queue = {source: source}, [source]
            for u in queue:
                for v, c in cap[u].items():
                    if c > 1e-9 and v not in came:
                        came[v] = u
                        queue.append(v)
                if sink in came:
                    break
            if sink not in came:
                break
            path, v = [], sink
            while v != source:
                path.append((came[v], v))
                v = came[v]
            flow = min(cap[u][v] for u, v in path)
            for u, v in path:
                cap[u][v] -= flow
                cap[v][u] = cap[v].get(u, 0.0) + flow
        for i in rest:
            label[i] = i in came
    return [bool(x) for x in label]


def smoothness(segments: list[int]) -> dict[tuple[int, int], float]:
    """Edges between neighbouring blocks, and from each block of a segment to the segment's first."""
    edges: dict[tuple[int, int], float] = {}
    first: dict[int, int] = {}
    for i, seg in enumerate(segments):
        if i:
            edges[(i - 1, i)] = WITHIN if seg and segments[i - 1] == seg else ACROSS
        if seg and seg in first and first[seg] != i - 1:
            edges[(first[seg], i)] = SEGMENT
        first.setdefault(seg, i)
    return edges


def cut_labels(model: BlockModel, places: list[tuple], skels: list[str], segments: list[int]) -> list[bool]:
    """True for the blocks on the content side of the minimum cut."""
    return minimum_cut([model.score(p, s) for p, s in zip(places, skels)], smoothness(segments))


def main_body(page: str, model: BlockModel) -> tuple[list[str], list[bool]]:
    """Texts of the main body's blocks in page order, and which of them are listings."""
    blocks = visible_blocks(page)
    places, skels, segments, _ = describe(blocks)
    body = [b for b, keep in zip(blocks, cut_labels(model, places, skels, segments)) if keep]
    return [b.text for b in body], [any(e[1] in LISTING for e in b.chain) for b in body]
