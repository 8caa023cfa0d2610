"""Main text of web pages: flat blocks, classified by a decision tree on shallow features.

Every block is described by its word count and link density, those of its neighbours, and what its
containers say (``page_blocks``).  The tree is grown here from ``EXAMPLES``, a small labelled table of
blocks; another table can be handed in.  Blocks found to be text of the article are joined in page
order by one space, whole; nothing is dropped by length.

Pages are independent of each other, so there is no shuffle: each Arrow batch is parsed, all its
blocks are classified at once, and the texts go out.

Defined results: a null or empty page, or one without main text, has the empty text; repeated rows
are extracted row by row; an empty table gives an empty table; other columns of the table stay as
they are, but for one named ``text``, in whose place the text stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge.llm.common import ship
from placegauge.llm.page_blocks import Block, blocks, features

# Rows of a batch that are parsed before their blocks are classified.
SLICE_PAGES = 200

# Labelled blocks, page by page: containers and element, words, words in links, how the text ends
# (``.`` like a sentence, ``-`` otherwise, ``©`` a note on rights), and whether it is main text (1).
EXAMPLES = """
nav>ul>li 1 1 - 0
nav>ul>li 2 2 - 0
nav>ul>li 1 1 - 0
div.ad>div 8 0 . 0
article>h1 9 0 - 1
article>p 70 0 . 1
article>p 1 0 . 1
article>p 3 0 . 1
article>p 90 4 . 1
article>h2 4 0 - 1
article>p 2 0 . 1
article>ul>li 6 0 - 1
article>ul>li 3 3 - 1
article>ul>li 12 2 . 1
article>p 5 5 - 1
article>p 40 0 - 1
footer>div 14 0 . 0
footer>div 6 0 © 0

header>div 3 3 - 0
header>nav>ul>li 1 1 - 0
header>nav>ul>li 1 1 - 0
div.cookie-notice>p 25 2 . 0
main>article>header>h1 7 0 - 1
main>article>header>p 4 1 - 0
main>article>p 120 3 . 1
main>article>aside>p 30 0 . 0
main>article>p 14 0 . 1
main>article>blockquote 22 0 . 1
main>article>figure>figcaption 9 0 - 1
main>article>table>tr>td 2 0 - 1
main>article>table>tr>td 1 0 - 1
main>article>pre 18 0 - 1
main>article>footer>p 12 2 - 0
main>section.comments>h3 2 0 - 0
main>section.comments>p 45 0 . 0
main>section.comments>p 60 1 . 0
main>div.related>ul>li 8 8 - 0
main>h3 2 0 - 0
main>ul>li 7 7 - 0
main>ul>li 9 9 - 0
aside>p 35 5 . 0
footer>p 20 8 - 0

div.menu>div 5 5 - 0
div.content>h1 6 0 - 1
div.content>p 55 2 . 1
div.content>p 4 0 . 1
div.content>div 30 0 . 1
div.content>div.share>div 4 4 - 0
div.content>p 80 0 . 1
div.content>ol>li 9 0 . 1
div.content>ol>li 2 0 - 1
div.content>form>label 3 0 - 0
div.content>form>p 11 0 . 0
div.sidebar>h3 2 0 - 0
div.sidebar>p 40 0 . 0
div.footer>p 9 0 © 0

div>h1 8 0 - 1
div.article-body>p 33 0 . 1
div.article-body>p 2 0 - 1
div.article-body>h3 3 0 - 1
div.article-body>p 1 1 - 1
div.article-body>p 4 0 © 1
div.article-body>p 61 6 . 1
div>p 15 0 . 0
div>p 28 0 . 0
div.comments>p 31 0 . 0
div>ul>li 4 4 - 0
div>div 7 0 © 0

div>h1 3 3 - 0
div>div 2 2 - 0
article>h1 10 0 - 1
article>p 1 0 . 1
article>p 2 0 . 1
article>p 1 0 . 1
article>p 8 8 - 1
article>div.ad>p 18 0 . 0
article>p 6 0 . 1
article>p 5 0 © 1
article>p 12 0 © 1
div>p 50 0 . 0
div>div 12 0 . 0
div.newsletter>form>p 13 0 . 0
div>p 5 0 © 0

div>div 6 6 - 0
div>ul>li 1 1 - 0
div>ul>li 2 2 - 0
div>ul>li 1 1 - 0
div>h1 7 0 - 1
div>p 48 0 . 1
div>p 3 0 . 1
div>p 66 5 . 1
div>h2 4 0 - 1
div>p 9 0 . 1
div>p 37 1 . 1
div>ul>li 11 0 . 1
div>ul>li 8 0 . 1
div>p 29 0 . 1
div>div 5 4 - 0
div>div 3 3 - 0
div>p 8 0 © 0

body>div 4 0 - 0
body>div 9 9 - 0
body>h1 5 0 - 1
body>div 75 2 . 1
body>div 43 0 . 1
body>div 110 1 . 1
body>h2 3 0 - 1
body>div 52 0 . 1
body>div 6 6 - 0
body>div 10 7 - 0
body>div 4 0 - 0
body>div 11 0 © 0

div.nav>div 3 3 - 0
table>tr>td 4 4 - 0
table>tr>td 85 3 . 1
table>tr>td 40 0 . 1
table>tr>td 6 5 - 0
table>tr>td 3 0 - 0
table>tr>td 9 0 © 0

nav>div 9 9 - 0
main>h1 6 0 - 1
main>p 1 0 . 1
main>p 77 0 . 1
main>div 24 0 . 1
main>p 3 0 . 1
main>ul>li 5 0 - 1
main>ul>li 4 0 - 1
main>p 12 2 . 1
main>div.promo>p 21 3 . 0
main>p 46 0 . 1
main>p 5 0 © 1
div>p 19 0 . 0
div.popup>div 16 2 . 0
footer>ul>li 2 2 - 0

div>p 20 20 - 0
div>h2 5 5 - 0
div>p 26 4 . 1
div>p 58 0 . 1
div>p 7 0 . 1
div>p 64 0 . 1
div>h3 2 0 - 0
div>ul>li 6 6 - 0
div>ul>li 9 9 - 0
div>p 10 3 © 0

nav>ul>li 1 1 - 0
nav>ul>li 2 2 - 0
article>h1 5 0 - 1
article>p 44 0 . 1
article>p 2 0 . 1

div>p 64 0 . 1

div>div 3 3 - 0
div>h1 7 0 - 1
div>p 1 0 . 1
div>p 2 0 . 1
div>p 50 0 . 1
div>p 2 0 . 1
div>p 3 0 . 1
div>p 1 0 - 1
div>p 31 0 . 1
div>div 8 0 . 0
div>div 5 0 - 0

h1 6 0 - 1
p 3 0 . 1
p 18 0 . 1
p 4 1 . 1

div.main>h2 3 0 - 1
div.main>p 9 0 . 1
div.main>div 2 0 - 1
div.main>p 36 0 . 1

nav>ul>li 2 2 - 0
article>h1 4 0 - 1
article>p 200 0 - 1

main>p 33 0 - 1

p 500 0 - 1

div>div 90 0 - 1

article>p 2 0 - 1

div>ul>li 2 2 - 0
div>h1 3 0 - 1
div>p 47 0 - 1
div>p 38 0 - 1
div>p 4 0 . 1
div>p 63 0 - 1
div>div 2 2 - 0
div>div 6 0 © 0

div>div 4 4 - 0
div>p 82 1 . 1
div>p 5 0 . 1
div>p 24 0 - 1
div>div 3 3 - 0
p 4 0 © 0

div>ul>li 1 1 - 0
div>p 6 0 . 0
div>ul>li 3 3 - 0
div>p 11 0 . 0
div>ul>li 2 2 - 0
div>h1 7 0 - 1
div>p 83 2 . 1
div>p 6 0 . 1
div>p 57 0 . 1
div>div 5 5 - 0
div>p 8 0 . 0
div>div 4 4 - 0
div>p 13 0 - 0
div>div 3 3 - 0
"""


def example_pages(examples: str = EXAMPLES) -> list[tuple[str, list[bool]]]:
    """The pages that the labelled table describes, and the label of each of their blocks."""
    pages = []
    for page in examples.strip().split("\n\n"):
        markup, labels = [], []
        for line in page.splitlines():
            path, words, linked, end, label = line.split(" ")
            tags = [step.split(".") for step in path.split(">")]
            text = ["word"] * int(words)
            if end == "©":
                text[0] = "©"
            if int(linked):
                text[0], text[int(linked) - 1] = f"<a href=x>{text[0]}", f"{text[int(linked) - 1]}</a>"
                if int(linked) == 1:
                    text[0] = "<a href=x>word</a>"
            body = " ".join(text) + ("." if end == "." else "")
            opened = "".join(f'<{t} class="{c[0]}">' if c else f"<{t}>" for t, *c in tags)
            markup.append(opened + body + "".join(f"</{t}>" for t, *_ in reversed(tags)))
            labels.append(label == "1")
        pages.append(("".join(markup), labels))
    return pages


@dataclass
class DecisionTree:
    """Nodes as arrays: a row goes left where its feature is at most the threshold; -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """Share of main text among the labelled blocks of the leaf that each row reaches."""
        at = np.zeros(len(rows), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.share[at]
            node = at[inner]
            goes_left = rows[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(goes_left, self.left[node], self.right[node])


def grown(rows: np.ndarray, labels: np.ndarray, depth: int = 10, least: int = 2) -> DecisionTree:
    """A tree of the splits that lower the Gini impurity most; ties go to the first feature."""
    nodes: list[list[float]] = []

    def split(chosen: np.ndarray) -> tuple[float, int, float] | None:
        best = None
        for f in range(rows.shape[1]):
            order = chosen[np.argsort(rows[chosen, f], kind="stable")]
            x, y = rows[order, f], labels[order].astype(float)
            n, main = np.arange(1, len(y)), np.cumsum(y)[:-1]
            rest_n, rest = len(y) - n, y.sum() - main
            # Twice the summed variance of both sides, up to a constant factor.
            impurity = main - main**2 / n + rest - rest**2 / rest_n
            allowed = (x[1:] > x[:-1]) & (n >= least) & (rest_n >= least)
            if allowed.any():
                k = int(np.argmin(np.where(allowed, impurity, np.inf)))
                if best is None or impurity[k] < best[0] - 1e-9:
                    best = (float(impurity[k]), f, float(x[k] + x[k + 1]) / 2)
        return best

    def grow(chosen: np.ndarray, level: int) -> int:
        here, main = len(nodes), labels[chosen].mean()
        nodes.append([-1, 0.0, -1, -1, main])
        found = split(chosen) if 0 < main < 1 and level < depth else None
        if found:
            _, f, threshold = found
            low = rows[chosen, f] <= threshold
            left = grow(chosen[low], level + 1)
            right = grow(chosen[~low], level + 1)
            nodes[here][:4] = [f, threshold, left, right]
        return here

    grow(np.arange(len(rows)), 0)
    table = np.array(nodes)
    whole = [table[:, k].astype(np.int64) for k in (0, 2, 3)]
    return DecisionTree(whole[0], table[:, 1], whole[1], whole[2], table[:, 4])


def trained(examples: str = EXAMPLES) -> DecisionTree:
    """The tree that the labelled blocks teach."""
    rows, labels = [], []
    for page, wanted in example_pages(examples):
        found = blocks(page)
        if len(found) != len(wanted):
            raise ValueError("a labelled line has to be one block")
        rows.append(features(found))
        labels += wanted
    return grown(np.concatenate(rows), np.array(labels))


def main_texts(pages: list[str | None], tree: DecisionTree, least_share: float = 0.5) -> list[str]:
    """The main text of every page."""
    parsed: list[list[Block]] = [blocks(page) for page in pages]
    flat = [block for found in parsed for block in found]
    if not flat:
        return [""] * len(pages)
    main = iter(tree.shares(np.concatenate([features(found) for found in parsed])) >= least_share)
    return [" ".join(block.text for block in found if next(main)) for found in parsed]


def extracted(
    pages: DataFrame, column: str = "html", examples: str = EXAMPLES, least_share: float = 0.5
) -> DataFrame:
    """``pages`` with the main text of ``column`` as ``text``."""
    ship(pages.sparkSession)
    tree = trained(examples)
    kept = [c for c in pages.columns if c not in (column, "text")]
    source = pages.select(F.col(column).alias("text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_PAGES):
                part = batch.slice(low, SLICE_PAGES)
                texts = main_texts(part.column(0).to_pylist(), tree, least_share)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()), *part.columns[1:]], schema=part.schema
                )

    return source.mapInArrow(run, source.schema).select(*kept, "text")
