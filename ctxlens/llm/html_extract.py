"""Main text of web pages by gradient-boosted trees over the nodes of the page (operator 13).

Each node of a page's tree gets a log-odds of holding text of the article, from the trees. Decoding picks, among the choices that
don't contradict one another (below a node that is left out everything is left out, above a kept one everything is kept), the one with the
largest sum; the kept leaves are the text.

The trees are fitted by Spark on a bounded sample of the pages. Pages with one <article> or <main> label themselves. As most pages of
the world have no such landmark, the sampled pages' blocks are also set anew into layouts of many kinds, whose labels are known.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh_dir, map_text
from .html_dom import BOILERPLATE, CONTENT, GROUP, NAMES, TEXT, TOKENS, Dom, Reader, features
from .html_layouts import lay_out


@dataclass(frozen=True)
class Params:
    """sample: pages that the trees are fitted on (the bound), the least by a hash of their ids. layouts: new pages made of their blocks, in all.

    chars: of a sampled page at most so many characters are used in fitting. trees, depth, rate: of the boosting.
    """

    sample: int = 400
    layouts: int = 1600
    chars: int = 200_000
    trees: int = 24
    depth: int = 5
    rate: float = 0.3
    seed: int = 13


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in arrays: feature (-1: a leaf), threshold, left, right, value; where each tree begins and what it weighs."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, go)
            out += weight * self.value[at]
        return 2 * out


def landmark_labels(dom: Dom) -> dict[int, bool] | None:
    """Leaf -> whether it is in the page's only <article> or <main>, outside all that calls itself something else; None without such a one.

    A <main> around an <article> doesn't count.
    """
    marks = [i for i, g in enumerate(dom.group) if g == GROUP["article"]]
    marks = [i for i in marks if not any(i < j < dom.end[i] for j in marks)]
    if len(marks) != 1:
        return None
    a, z = marks[0], dom.end[marks[0]]
    return {i: a < i < z and not (dom.above[i] & ~dom.above[a]) & BOILERPLATE for i in dom.texts}


def node_labels(dom: Dom, leaves: dict[int, bool]) -> np.ndarray:
    """A node holds text of the article if a leaf inside does."""
    upto = np.zeros(len(dom.parent) + 1, int)
    for i, yes in leaves.items():
        upto[i + 1] = yes
    upto = np.cumsum(upto)
    return (upto[np.array(dom.end)] - upto[np.arange(len(dom.parent))]) > 0


def decode(dom: Dom, score: np.ndarray) -> list[int]:
    """Leaves of the consistent choice with the largest sum of scores; the root counts as kept."""
    n = len(dom.parent)
    s = np.clip(score, -6, 6).tolist()
    drop, keep = [-x for x in s], list(s)
    for i in range(n - 1, 0, -1):  # children come after their parent
        p = dom.parent[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    out, i = [], 0
    while i < n:
        if i and keep[i] < drop[i]:
            i = dom.end[i]
            continue
        if dom.group[i] == TEXT:
            out.append(i)
        i += 1
    return out


def _fields() -> list:
    return [T.StructField("label", T.DoubleType(), False), T.StructField("features", T.ArrayType(T.DoubleType(), False), False)]


def training_rows(sample: DataFrame, each: int, p: Params, html: str = "html") -> DataFrame:
    """(label, features) of the nodes of sampled pages with a landmark, and of ``each`` layouts made of every sampled page's blocks."""
    import pyarrow as pa

    schema = T.StructType(_fields())

    def run(batches):
        reader = Reader()
        for b in batches:
            for key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng([p.seed, key % (1 << 63)])
                dom = reader.parse(page[: p.chars])
                labelled = [(dom, x)] if (x := landmark_labels(dom)) is not None else []
                for _ in range(each):
                    made, want = lay_out(rng, list(dom.texts.values()), TOKENS)
                    tree = reader.parse(made)
                    if len(want) == len(tree.texts):
                        labelled.append((tree, dict(zip(tree.texts, want, strict=True))))
                x = features([d for d, _ in labelled])
                y = np.concatenate([node_labels(d, leaves) for d, leaves in labelled]) if labelled else np.zeros(0)
                ends = np.arange(len(x) + 1, dtype="i4") * len(NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(y.astype("f8")), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["label", "features"])

    src = sample.select("key", F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    return src.mapInArrow(run, schema)


def fit(pages: DataFrame, p: Params = Params(), page_id: str = "page_id", html: str = "html") -> Trees:
    """Trees from at most ``p.sample`` pages. Ids are read first and the sampled pages alone afterwards; pages without an id aren't sampled."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = pages.sparkSession
    key = F.xxhash64(F.col(page_id), F.lit(p.seed))
    ids = pages.select(F.col(page_id).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id", F.lit(p.seed)), "id").limit(p.sample)
    ids = [r.id for r in ids.collect()]
    if not ids:
        return Trees(*(np.zeros(0, k) for k in ("i4", "f8", "i4", "i4", "f8", "i4", "f8")), 0)
    sample = pages.where(F.col(page_id).isin(ids)).select(key.alias("key"), F.col(html).alias("html")).orderBy("key", "html").limit(2 * p.sample)
    rows = cut(training_rows(sample, -(-p.layouts // len(ids)), p, "html"))
    model = GBTClassifier(maxIter=p.trees, maxDepth=p.depth, stepSize=p.rate, seed=p.seed, minInstancesPerNode=5, maxBins=48).fit(rows.select("label", array_to_vector("features").alias("features")).coalesce(4))
    folder = fresh_dir(spark, "html-trees")
    model.save(folder)
    return load(spark, folder, model.treeWeights)


def load(spark: SparkSession, folder: str, weights: list[float]) -> Trees:
    """Trees of a saved gradient-boosted model, and their weights; their number is a parameter of the fit."""
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    roots: dict[int, int] = {}
    for i, r in enumerate(nodes):
        roots.setdefault(r.treeID, i)
    rows = [(r.split.featureIndex if r.leftChild >= 0 else -1, r.split.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else 0.0, roots[r.treeID] + r.leftChild, roots[r.treeID] + r.rightChild, r.prediction) for r in nodes]
    cols = [np.array(c, k) for c, k in zip(zip(*rows, strict=True), ("i4", "f8", "i4", "i4", "f8"), strict=True)]
    depth: dict[int, int] = {}
    deepest = 0
    for i, (f, _, a, z, _) in enumerate(rows):
        d = depth.setdefault(i, 0)
        deepest = max(deepest, d)
        if f >= 0:
            depth[a] = depth[z] = d + 1
    return Trees(*cols, np.array(list(roots.values())), np.array(weights), deepest)


def main_texts(reader: Reader, trees: Trees, pages: list[str]) -> list[str]:
    doms = [reader.parse(t) for t in pages]
    score = trees.log_odds(features(doms)) if len(trees.roots) else np.full(sum(len(d.parent) for d in doms), 1.0)
    out, at = [], 0
    for d in doms:
        out.append("\n\n".join(d.texts[i] for i in decode(d, score[at : at + len(d.parent)])))
        at += len(d.parent)
    return out


def extract(pages: DataFrame, trees: Trees, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) with ``text`` and ``n_chars``, its code points.

    Blocks of the article in page order, joined by two line feeds; character references are decoded, white space inside a
    block is one space. Null, empty and textless pages give an empty text. Rows are independent: repeated rows and ties need no rule, an
    empty table gives none; ``keep`` columns that have a computed name are replaced. No shuffle.
    """
    fields = [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)]

    def make():
        reader = Reader()

        def f(texts):
            got, batch, size = [], [], 0
            for t in texts:  # pages of about 2 MB together
                batch.append(t)
                size += len(t)
                if size > 2_000_000:
                    got += main_texts(reader, trees, batch)
                    batch, size = [], 0
            got += main_texts(reader, trees, batch) if batch else []
            return [got, list(map(len, got))]

        return f

    return map_text(pages, make, fields, keep or pages.columns, html)


def extract_pages(pages: DataFrame, p: Params = Params(), page_id: str = "page_id", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Fits on a sample of the pages and extracts from all of them."""
    return extract(pages, fit(pages, p, page_id, html), html, keep)
