"""Main text of hand-written pages that the given ones do not resemble, by a model trained on the given ones."""

import os
import re

import pyarrow.parquet as pq
import pytest

from lociary.llm import dom_content

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")

S = "This is a sentence of the story that goes on for some time, as sentences do."
T = "Another part of it follows here and says a little more about the same thing."
U = "At last the piece comes to its end with this long and well formed sentence."
N = '<nav><a href=/>Home</a> <a href=/a>About us</a></nav>'
F = "<footer><p>Copyright 2024 Example company, all rights reserved.</p></footer>"

TRIALS = {
    "table": (f"<body>{N}<article><h1>Title here</h1><p>{S}</p><table><tr><th>Year</th><th>Value</th></tr><tr><td>1999</td><td>12 tons of grain</td></tr></table><p>{T}</p></article>{F}</body>",["Title here",S,"Year","Value","1999","12 tons of grain",T]),
    "figcaption": (f"<body>{N}<article><p>{S}</p><figure><img src=x><figcaption>A house by the sea</figcaption></figure><p>{T}</p></article>{F}</body>",[S,"A house by the sea",T]),
    "second div": (f"<body>{N}<article><div>{S}</div><div>{T}</div></article>{F}</body>",[S,T]),
    "tags word": (f"<body>{N}<article><p>{S}</p><div class='story long tags'><p>{T}</p></div></article>{F}</body>",[S,T]),
    "plain div": (f"<body>{N}<div><p>{S}</p><p>{T}</p></div>{F}</body>",[S,T]),
    "list": (f"<body>{N}<main><p>{S}</p><ul><li>First point of it</li><li>Second point</li></ul><p>{T}</p></main>{F}</body>",[S,"First point of it","Second point",T]),
    "comments": (f"<body>{N}<article><p>{S}</p><p>{T}</p></article><div class=comments><p>I liked this very much, thank you for the story.</p><p>Me too, it was a good read for me.</p></div>{F}</body>",[S,T]),
    "sidebar": (f"<body>{N}<div class=content><p>{S}</p><p>{U}</p></div><aside><p>Read also this other piece on our pages.</p></aside>{F}</body>",[S,U]),
    "newsletter inside": (f"<body>{N}<article><p>{S}</p><div class='newsletter'><p>Subscribe to our weekly letter and never miss a story.</p></div><p>{T}</p></article>{F}</body>",[S,T]),
    "section": (f"<body><header><h1>Site name</h1></header><article><section><h2>Part one</h2><p>{S}</p></section><section><h2>Part two</h2><p>{T}</p></section></article>{F}</body>",["Part one",S,"Part two",T]),
    "quote+pre": (f"<body>{N}<article><blockquote>{S}</blockquote><pre>x = 1</pre><p>{U}</p></article>{F}</body>",[S,"x = 1",U]),
    "short article": (f"<body>{N}<article><p>Yes.</p></article>{F}</body>",["Yes."]),
    "comments in article": (f"<body>{N}<article><p>{S}</p><section id=comments><p>I liked this very much, thank you for the story.</p></section></article>{F}</body>",[S]),
    "cookie": (f"<body><div class='cookie-banner'><p>We use cookies to make this page work well for you.</p><button>OK</button></div>{N}<article><p>{S}</p></article></body>",[S]),
}


@pytest.fixture(scope="module")
def pages():
    docs = dict(zip(*(pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).columns[k].to_pylist() for k in (0, 1))))
    rows = pq.read_table(f"{DATA}/pages.parquet", columns=["url", "html"]).to_pylist()
    number = lambda url: re.search(r"^.*?://[^/?#]*[^?#0-9]*([0-9]+)", url or "", re.S)
    return [(r["html"], docs.get(int(number(r["url"])[1]))) for r in rows if r["html"] and number(r["url"]) and docs.get(int(number(r["url"])[1]))]


@pytest.fixture(scope="module")
def model(pages):
    return dom_content.fit(pages)


@pytest.mark.parametrize("name", TRIALS)
def test_article_is_kept_whole(model, name):
    page, wanted = TRIALS[name]
    assert dom_content.main_texts([page], model) == ["\n".join(wanted)]


def test_given_pages_give_their_documents(model, pages):
    packed = lambda text: "".join(text.split())
    for got, (_, document) in zip(dom_content.main_texts([p for p, _ in pages], model), pages):
        assert packed(document) in packed(got)  # which has the heading besides


def test_training_changes_the_answer(model):
    page, wanted = TRIALS["comments"]
    untrained = dom_content.Model(dom_content.PRIOR.copy(), dom_content.PRIOR_PAIRS.copy())
    assert dom_content.main_texts([page], untrained) != ["\n".join(wanted)] == dom_content.main_texts([page], model)
