"""Main text of HTML pages by a tree-structured graphical model over the DOM.

A page becomes the tree of its block elements; inline elements belong to the block around them. Each node is content
or not. Node potentials are a linear function of the element (kind of tag, words in class and id, length, links,
punctuation of its own text), and a table of potentials couples each child with its parent. One sum-product pass
upward and one downward give the exact marginal of every node; the text of nodes above one half is the page's.

The weights are the maximum a posteriori of a conditional random field, by gradient steps on exact node and edge
marginals, from labelled pages: a block of a page is content where its text is found in the document that the page shows.
Training reads ``TRAIN_PAGES`` pages chosen by a hash of the id. Every training tree is repeated with paragraphs under
containers of page furniture, and with its content under plain containers, so that kinds of furniture which the sample
lacks are not judged by their paragraphs alone. Parsing and inference run in Arrow batches and read every page whole.
"""

from __future__ import annotations

import html as html_library
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lociary.llm.common import column_of, ship, slices

TRAIN_PAGES = 300
STEPS = 150
MIN_FOUND = 25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

# Kinds of HTML elements, and words that page furniture and main text carry in class and id.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSHOWN = frozenset("template svg canvas video audio select datalist button annotation annotation-xml".split())
TRANSPARENT = frozenset("noscript object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup"
    " msup mtable mtd mtext mtr munder munderover none semantics".split()
)
FURNITURE = frozenset("nav footer header aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LIST = frozenset("ul ol dl li dt dd".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
PROSE = frozenset("p blockquote pre figcaption".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table body html".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright"
    " disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted"
    " promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser"
    " toolbar topbar widget".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main post prose story text".split())

FEATURES = ["bias", "furniture", "article", "heading", "list", "table", "prose", "container", "furniture word", "content word", "text", "length", "links", "ends", "root", "mixed words"]
#: Where the weights are drawn to: signs only, of what the sample shows nothing of.
PRIOR = np.array([0.0, -3.0, 3.0, 0.5, 0.0, 0.0, 0.5, 0.0, -3.0, 1.0, 0.0, 0.2, -1.0, 0.3, 0.0, -0.5])
PRIOR_PAIRS = np.array([[1.0, -2.0], [0.0, 1.0]])  # parent by child
PULL = 0.02
KNOWN = 60.0


@dataclass
class Tree:
    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    words: list[int] = field(default_factory=lambda: [0])  # 1: furniture, 2: content
    links: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str]] = field(default_factory=list)  # (node, text) in page order


def _class_words(attributes: str) -> int:
    found = 0
    for groups in ATTRIBUTE.findall(attributes):
        for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(groups)).lower()):
            found |= (word in FURNITURE_WORDS) | (word in CONTENT_WORDS) << 1
    return found


def parse(html: str) -> Tree:
    """Blocks and their texts. Character references are decoded, white space in a block is one space.

    The text of ``RAW`` elements ends at their own end tag. Unshown and hidden elements are elements like others whose
    text and blocks are left out: where their end tag is missing they end with the block around them, and inside text
    (buttons, choices, hidden inline elements) also before an article. ``TRANSPARENT`` elements are nodes of their own
    that end no paragraph.
    """
    tree = Tree()
    open_tags: list[tuple[str, int, int]] = [("html", 0, 0)]  # every open element with its block and the place from which all is left out
    still_open: Counter[str] = Counter()  # of each tag, so that deep pages are not searched in vain
    shown_open: Counter[str] = Counter()  # of these, what is not left out
    parts: list[str] = []
    owner = 0  # the block of the parts
    at, size = 0, len(html)

    def opens(tag: str, node: int, unshown: bool = False) -> None:
        open_tags.append((tag, node, open_tags[-1][2] or (len(open_tags) if unshown else 0)))
        still_open[tag] += 1
        shown_open[tag] += not open_tags[-1][2]

    def closes(place: int) -> None:
        for tag, _, unshown in open_tags[place:]:
            still_open[tag] -= 1
            shown_open[tag] -= not unshown
        del open_tags[place:]

    def close_run() -> None:
        if parts:
            text = " ".join(html_library.unescape("".join(parts)).split())
            if text:
                tree.runs.append((owner, text))
            parts.clear()

    def add(text: str) -> None:
        nonlocal owner
        _, node, unshown = open_tags[-1]
        if unshown:
            return
        if node != owner and not text.isspace():
            close_run()
            owner = node
        parts.append(text)
        if still_open["a"]:
            tree.links[node] += len(text.strip())

    while at < size:
        token = TOKEN.search(html, at)
        if token is None:
            add(html[at:])
            break
        if token.start() > at:
            add(html[at : token.start()])
        at = token.end()
        if token["tag"] is None:
            if token["data"]:
                add(html_library.escape(token["data"]))
            continue
        tag = token["tag"].lower()
        if not token["end"]:
            if tag in RAW:
                if not token["attributes"].endswith("/"):
                    last = re.compile(rf"</{re.escape(tag)}\s*>|</{re.escape(tag)}(?=[\s/])[^>]*>", re.I).search(html, at)
                    at = last.end() if last else size
                parts.append(" ")
            elif tag in UNSHOWN or (token["attributes"] and HIDDEN_ATTRIBUTE.search(token["attributes"]) and tag in INLINE):
                if not token["attributes"].endswith("/"):
                    opens(tag, open_tags[-1][1], True)
                parts.append(" ")
            elif tag in VOID:
                if tag == "hr" and not open_tags[-1][2]:
                    close_run()
                else:
                    parts.append(" " if tag == "br" else "")
            elif tag in INLINE:
                opens(tag, open_tags[-1][1])
            elif tag in TRANSPARENT:
                if not token["attributes"].endswith("/"):
                    opens(tag, open_tags[-1][1] if open_tags[-1][2] else _node(tree, open_tags[-1][1], tag, token["attributes"]))
                parts.append(" ")
            elif tag in ("html", "body"):
                if tag == "body" and not still_open["body"]:
                    close_run()
                    closes(1)
                    opens(tag, _node(tree, 0, tag, token["attributes"]))
            else:
                place = open_tags[-1][2]
                if place and tag in ARTICLE and (open_tags[place][0] in INLINE or open_tags[place][0] in ("button", "select", "datalist")):
                    closes(place)
                ended = CLOSES.get(tag, ("p",))
                if any(shown_open[t] for t in ended):
                    place = _implied_end(open_tags, ended, tag)
                    if place:
                        close_run()
                        closes(place)
                if not open_tags[-1][2]:
                    close_run()
                    opens(tag, _node(tree, open_tags[-1][1], tag, token["attributes"]))
                elif not token["attributes"].endswith("/"):
                    opens(tag, open_tags[-1][1])
        elif tag in INLINE:
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] == tag:
                    if open_tags[-1][2]:  # what is left out ends with the element around it
                        closes(k)
                    else:
                        still_open[tag] -= 1
                        shown_open[tag] -= 1
                        del open_tags[k]
                    break
                if open_tags[k][0] not in INLINE:
                    break
        elif tag not in RAW and tag not in VOID and tag not in ("html", "body"):
            if still_open[tag]:
                place = next(k for k in range(len(open_tags) - 1, 0, -1) if open_tags[k][0] == tag)
                if tag not in TRANSPARENT and not open_tags[place][2]:
                    close_run()
                closes(place)
    close_run()
    return tree


def _node(tree: Tree, parent: int, tag: str, attributes: str) -> int:
    tree.parent.append(parent)
    tree.tag.append(tag)
    tree.words.append(_class_words(attributes) if attributes else 0)
    tree.links.append(0)
    return len(tree.tag) - 1


def _implied_end(open_tags: list, ended: tuple[str, ...], by: str) -> int:
    """Place of the innermost open element of these tags that is not left out, not reaching over a list, a table or a furniture element; else 0.

    A block in a button, a picture or a template does not end the paragraph around it, but the next paragraph does.
    """
    for k in range(open_tags[-1][2] or len(open_tags) - 1, 0, -1):
        tag = open_tags[k][0]
        if tag in ended and not open_tags[k][2]:
            return k
        if tag in LIMITS or tag in FURNITURE or tag in ARTICLE or (tag in UNSHOWN and ended == ("p",) and by != "p"):
            break
    return 0


def features(tree: Tree) -> np.ndarray:
    """One row of ``FEATURES`` per node."""
    n = len(tree.tag)
    own, ends = np.zeros(n), np.zeros(n)
    for node, text in tree.runs:
        own[node] += len(text)
        ends[node] += text[-1] in ".!?…\"'”»:" and " " in text
    kinds = (FURNITURE, ARTICLE, HEADING, LIST, TABLE, PROSE)
    rows = np.zeros((n, len(FEATURES)))
    rows[:, 0] = 1
    for i, (tag, words) in enumerate(zip(tree.tag, tree.words)):
        kind = next((k for k, tags in enumerate(kinds) if tag in tags), len(kinds))
        rows[i, 1 + kind] = 1
        rows[i, 8 if words == 1 else 9 if words == 2 else 15] = words > 0 and tag != "body"
    rows[:, 10] = own > 0
    rows[:, 11] = np.minimum(np.log1p(own), 7) / 2
    rows[:, 12] = np.where(own > 0, np.minimum(np.array(tree.links) / np.maximum(own, 1), 1), 0)
    rows[:, 13] = ends > 0
    rows[0, 14] = 1
    for i, tag in enumerate(tree.tag):
        rows[i, 14] += tag == "body"
    return rows


def potentials(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-potential of every node; root and body are known to hold the content."""
    return np.where(rows[:, 14] > 0, KNOWN, rows @ weights)


def levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth; parents stand before their children."""
    depth = np.zeros(len(parent), np.int64)
    for i in range(len(parent)):
        path = []
        while parent[i] >= 0 and not depth[i]:
            path.append(i)
            i = parent[i]
        for steps, node in enumerate(reversed(path), 1):
            depth[node] = depth[i] + steps
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def marginals(parent: np.ndarray, node: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 of every node, and the joint of (parent, child) labels of every node but the roots.

    ``node`` holds the log-potential of label 1 against 0. Sum-product in the log domain: messages go up from the
    deepest level to the roots, then down.
    """
    own = np.stack([np.zeros(len(node)), node], 1)
    order = levels(parent)
    up = np.zeros((len(node), 2))  # message of a node to its parent
    gathered = own.copy()
    for level in order[:0:-1]:
        up[level] = np.logaddexp.reduce(gathered[level][:, None, :] + pairs[None], axis=2)
        up[level] -= up[level].max(1, keepdims=True)
        np.add.at(gathered, parent[level], up[level])
    full = gathered.copy()  # belief of a node, with what comes from above
    joint = np.zeros((len(node), 2, 2))
    for level in order[1:]:
        above = full[parent[level]] - up[level]
        both = above[:, :, None] + pairs[None] + gathered[level][:, None, :]
        both -= both.max((1, 2), keepdims=True)
        joint[level] = np.exp(both) / np.exp(both).sum((1, 2), keepdims=True)
        down = np.logaddexp.reduce(above[:, :, None] + pairs[None], axis=1)
        full[level] = gathered[level] + down - down.max(1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700))), joint


@dataclass
class Model:
    weights: np.ndarray
    pairs: np.ndarray


def labels_of(tree: Tree, document: str) -> np.ndarray:
    """Content (1) or not (0) per node: text blocks by whether the document holds them, containers by whether they hold any.

    Blocks too short to tell are as their parent. Root and body are content: what they hold is judged by itself.
    """
    joined = "".join(document.split())
    n = len(tree.tag)
    good, all_ = np.zeros(n), np.zeros(n)
    short = np.zeros(n, bool)
    for node, text in tree.runs:
        packed = "".join(text.split())
        short[node] |= len(packed) < MIN_FOUND
        if len(packed) >= MIN_FOUND:
            all_[node] += len(packed)
            good[node] += len(packed) * (packed in joined)
    label = ((good * 2 > all_) & (all_ > 0)).astype(np.int64)
    textless = (all_ == 0) & ~short
    for i in range(n - 1, 0, -1):
        label[tree.parent[i]] |= label[i] & textless[tree.parent[i]]
    for i in range(n):
        if tree.parent[i] < 0 or tree.tag[i] == "body":
            label[i] = 1
        elif short[i] and all_[i] == 0:
            label[i] = label[tree.parent[i]] if tree.tag[tree.parent[i]] != "body" else 0
    return label


def _varied(rows: np.ndarray, parent: np.ndarray, label: np.ndarray, rng: np.random.Generator):
    """The tree with fewer paragraphs of content, and some of those as cells, captions, plain blocks or under mixed words."""
    rows, parent, kept = rows.copy(), parent.copy(), np.ones(len(rows), bool)
    prose = np.flatnonzero((rows[:, 6] == 1) & (label == 1) & ~np.isin(np.arange(len(rows)), parent))
    if len(prose) > 1 and rng.random() < 0.6:
        kept[rng.permutation(prose)[rng.integers(1, min(4, len(prose))) :]] = False
    added, parents = [], []

    def above(node: int, kind: int) -> None:
        row = np.zeros(len(FEATURES))
        row[0] = row[kind] = 1
        added.append(row)
        parents.append(int(parent[node]))
        parent[node] = len(rows) + len(added) - 1

    for node in prose[kept[prose]].tolist():
        draw = rng.random()
        if draw > 0.8:  # in a block of its own, which may carry words of both kinds
            above(node, 7)
            added[-1][15] = rng.random() < 0.4
        elif draw < 0.36:
            kind = 5 if draw < 0.14 else 6 if draw < 0.22 else 7
            rows[node, 6], rows[node, kind] = 0, 1
            if kind != 7:  # a cell or a caption: short, mostly no sentence
                rows[node, 11], rows[node, 13] = np.log1p(rng.integers(2, 60)) / 2, rng.random() < 0.2
                above(node, 7 if kind == 6 else 5)
    rows = np.vstack([rows, *added]) if added else rows
    parent, label, kept = np.append(parent, parents).astype(np.int64), np.append(label, np.ones(len(added), np.int64)), np.append(kept, np.ones(len(added), bool))
    place = np.cumsum(kept) - 1
    return rows[kept], np.where(parent[kept] >= 0, place[parent[kept]], -1), label[kept]


def _augmented(rows: np.ndarray, parent: np.ndarray, label: np.ndarray, rng: np.random.Generator, bare: bool):
    """The tree again with furniture of paragraphs under the root or the content; ``bare``: its content under a plain container."""
    rows, parent, label = _varied(rows, parent, label, rng)
    plain = rows[:, 2] == 1
    if bare:
        rows[plain, 2], rows[plain, 7] = 0, 1
        rows[plain, rng.choice([0, 9, 15], p=[0.5, 0.3, 0.2])] = 1
    prose = np.flatnonzero((rows[:, 6] == 1) & (label == 1))
    hosts = np.flatnonzero((rows[:, 10] == 0) & (rows[:, 14] == 0) & (label == 1)).tolist() + [int(np.flatnonzero(rows[:, 14])[-1])]
    if not len(prose):
        return rows, parent, label
    added, parents, n = [], [], len(rows)
    parent, label = parent.copy(), label.tolist()
    for paragraph in prose[rng.random(len(prose)) < 0.2].tolist():  # as an item of a list of its own
        item = np.zeros(len(FEATURES))
        item[0] = item[4] = 1
        added.append(item)
        parents.append(int(parent[paragraph]))
        label.append(1)
        rows[paragraph, 6], rows[paragraph, 4] = 0, 1
        parent[paragraph] = n + len(added) - 1
    prose = prose[rows[prose, 6] == 1]
    if not len(prose):
        return np.vstack([rows, *added]), np.append(parent, parents), np.array(label)

    def box(host: int, named: bool, worded: bool) -> int:
        row = np.zeros(len(FEATURES))
        row[0], row[1], row[7], row[8] = 1, named, not named, worded
        added.append(row)
        parents.append(host)
        return n + len(added) - 1

    for _ in range(rng.integers(1, 4)):
        named = rng.random() < 0.5
        at = box(hosts[rng.integers(len(hosts))], named, (not named) or rng.random() < 0.3)
        nested = rng.random() < 0.4
        for paragraph in prose[rng.integers(len(prose), size=rng.geometric(0.15))]:
            host = box(at, False, rng.random() < 0.9) if nested else at
            added.append(rows[paragraph])
            parents.append(host)
    label += [0] * (n + len(added) - len(label))
    return np.vstack([rows, *added]), np.append(parent, parents), np.array(label)


def fit(pages: list[tuple[str, str]], seed: int = 3) -> Model:
    """From (html, shown document) pairs. Without pages the prior is the model."""
    model = Model(PRIOR.copy(), PRIOR_PAIRS.copy())
    rng = np.random.default_rng(seed)
    trees, labels, parents, offset = [], [], [], 0
    for page, document in pages:
        tree = parse(page)
        rows, parent, label = features(tree), np.array(tree.parent), labels_of(tree, document)
        if not label.any():
            continue
        for r, p, y in ((rows, parent, label), *(_augmented(rows, parent, label, rng, bare) for bare in (False, True, True))):
            trees.append(r)
            labels.append(y)
            parents.append(np.where(p >= 0, p + offset, -1))
            offset += len(r)
    if not trees:
        return model
    rows, label, parent = np.vstack(trees), np.concatenate(labels), np.concatenate(parents)
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[parent[child]], label[child]), 1)
    past_w, past_p = np.full(len(FEATURES), 1e-3), np.full((2, 2), 1e-3)
    for _ in range(STEPS):
        p, joint = marginals(parent, potentials(rows, model.weights), model.pairs)
        gradient = rows.T @ (label - p) / len(trees) - PULL * (model.weights - PRIOR)
        gradient_pairs = (seen - joint[child].sum(0)) / len(trees) - PULL * (model.pairs - PRIOR_PAIRS)
        past_w += gradient**2
        past_p += gradient_pairs**2
        model.weights += 0.3 * gradient / np.sqrt(past_w)
        model.pairs += 0.3 * gradient_pairs / np.sqrt(past_p)
    return model


def train(pages: DataFrame, documents: DataFrame, shown: DataFrame, limit: int = TRAIN_PAGES) -> Model:
    """``shown (page_id, doc_id)`` says which document a page shows. At most ``limit`` pages, chosen by a hash of the id."""
    chosen = shown.select("page_id", "doc_id").dropna().dropDuplicates().withColumn("order", F.xxhash64("page_id", "doc_id")).orderBy("order", "page_id", "doc_id").limit(limit)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("page_id", "order").agg(F.min("text").alias("text"))
    found = pages.select("page_id", "html").join(F.broadcast(texts), "page_id").groupBy("page_id", "order", "text").agg(F.min("html").alias("html"))
    rows = sorted(found.dropna().collect(), key=lambda r: (r["order"], r["page_id"]))
    return fit([(r["html"], r["text"]) for r in rows])


def main_texts(pages: list[str], model: Model) -> list[str]:
    """Main text of every page of a batch."""
    trees = [parse(p) for p in pages]
    sizes = np.array([len(t.tag) for t in trees])
    starts = np.cumsum(sizes) - sizes
    parent = np.concatenate([np.where(np.array(t.parent) >= 0, np.array(t.parent) + s, -1) for t, s in zip(trees, starts)])
    p, _ = marginals(parent, potentials(np.vstack([features(t) for t in trees]), model.weights), model.pairs)
    return ["\n".join(text for node, text in t.runs if p[s + node] > 0.5) for t, s in zip(trees, starts)]


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages (page_id, url, html)``; other columns are ignored.

    A null or empty page and a page without content has the empty text. Repeated rows stay as many rows, null ids and
    urls stay null, an empty table gives an empty table.
    """
    spark = pages.sparkSession
    ship(spark)
    frozen = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = main_texts([h or "" for h in column_of(batch, "html").to_pylist()], frozen.value)
            yield pa.record_batch(
                [column_of(batch, "page_id"), column_of(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
