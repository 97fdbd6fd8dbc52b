"""Main-text extraction by a linear-chain CRF over the blocks of a page.

A page is cut into its leaf blocks: stretches of text between block-level tags,
in page order. Each block is described by its own tag, its ancestors' tags and
class words, how much of it is links, its length, its punctuation and boilerplate words. A
conditional random field over the chain of blocks (main text or not) is trained on
labelled pages and decoded by Viterbi.

Labelled pages are a bounded sample of the table, labelled by what their authors
marked as article, and a few annotated layouts kept here. Half of the sampled
pages are shown to the trainer without their telling container tags, so the
model learns to read text and neighbourhood where pages are not marked up.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.llm.common import per_document

#: Sampled pages for training: those with the smallest hashes.
SAMPLE = 200
#: How often each layout kept here counts.
LAYOUT_WEIGHT = 10
#: Blocks of a training page that are used; decoding takes all of them.
TRAINED_BLOCKS = 120
ROUNDS, RATE, RIDGE = 250, 0.15, 3e-4

# HTML elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "iframe label legend li main menu nav noframes ol optgroup option p pre search section select "
    "summary table tbody td textarea tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style template head title".split())
RAW = frozenset("script style".split())  # nothing in them is markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes if it is open, up to a boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Class and id words, by what they tell.
HINTS = {
    "ad": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc",
    "side": "sidebar side aside widget rail related recommended popular trending more teaser",
    "foot": "footer foot copyright bottom legal colophon",
    "head": "header masthead topbar top logo branding",
    "comment": "comment comments respond reply replies disqus discussion feedback",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay toast message",
    "share": "share social sharing follow tags meta byline",
    "form": "form search login signup subscribe newsletter register contact",
    "main": "content article post entry story body text main page single prose",
}
_HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
_BOILER = re.compile(
    r"©|\bcopyright\b|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|"
    r"subscribe|sign (?:in|up)|log ?in|newsletter|\bshare\b|advertisement|sponsored",
    re.I,
)
#: Headings that readers' comments stand under.
_TALK = re.compile(
    r"\b(?:comments?|responses?|repl(?:y|ies)|discussion|reactions?|feedback|readers?|thoughts on|join the)\b", re.I
)
_COMMENTED = re.compile(r"\b(?:reply|replied|commented|says|wrote)\b", re.I)
_MARK = "data-main"


@dataclass
class Block:
    text: str
    tag: str
    ancestors: tuple[tuple[str, str], ...]  # (tag, class and id) from the root
    linked: int = 0
    marked: bool | None = None  # by an annotation


class _Blocks(HTMLParser):
    """Collects leaf blocks. Tolerates tags that are not closed or not open."""

    def __init__(self, skipped: frozenset[str] = SKIPPED) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped = skipped
        self.blocks: list[Block] = []
        self.open: list[tuple[str, str, bool | None]] = []
        self.parts: list[str] = []
        self.linked, self.in_link, self.skipping = 0, False, []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            marks = [m for _, _, m in self.open if m is not None]
            path = tuple((tag, names) for tag, names, _ in self.open)
            self.blocks.append(
                Block(text, path[-1][0] if path else "body", path, self.linked, marks[-1] if marks else None)
            )
        self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.skipping:
            if tag == self.skipping[-1] and tag not in VOID:
                self.skipping.append(tag)
            elif self.skipping[0] == "head" and tag == "body":  # a head that was left open
                self.skipping.clear()
            else:
                return
        if tag in self.skipped and not self.skipping:
            self.skipping.append(tag)
            return
        if self.skipping:
            return
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = True
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "hr":
                return
            self._close_implied(tag)
            values = dict(attrs)
            names = f"{values.get('class') or ''} {values.get('id') or ''} {values.get('role') or ''}".strip()
            mark = values.get(_MARK)
            self.open.append((tag, names, None if mark is None else mark == "1"))

    def _close_implied(self, tag: str) -> None:
        if self.open and self.open[-1][0] == "p":
            self.open.pop()
        closed, bounds = CLOSES.get(tag, (None, None))
        if closed:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in bounds:
                    break
                if self.open[i][0] in closed:
                    del self.open[i:]
                    break

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID or tag not in self.skipped:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        if tag == "a":
            self.in_link = False
        elif tag in BLOCK_TAGS:
            self.flush()
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.in_link:
                self.linked += len("".join(data.split()))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page: white space made single, references decoded, empty ones left out."""
    skipped = SKIPPED
    while True:
        parser = _Blocks(skipped)
        parser.feed(page)
        parser.close()
        parser.flush()
        # An element that never ends hides nothing: it is read again as if its tag meant nothing.
        if not parser.skipping or parser.skipping[0] not in skipped - RAW:
            break
        skipped -= {parser.skipping[0]}
    if not parser.blocks and parser.skipping:  # nothing but a script or style that never ends
        bare = re.sub(r"(?is)<(script|style)\b.*?(</\1>|$)|<!--.*?(-->|$)|<[^>]*>", " ", page)
        text = " ".join(entities.unescape(bare).split())
        return [Block(text, "body", ())] if text else []
    return parser.blocks


# Features

TELLING = frozenset("article main nav aside footer header".split())
APART = frozenset("nav aside footer form button select textarea".split())
APART_HINTS = frozenset("ad menu side foot comment notice share form".split())


@lru_cache(maxsize=50_000)
def _path_features(path: tuple[tuple[str, str], ...], hidden: bool) -> tuple[str, ...]:
    found: dict[str, None] = {}
    deepest = "none"
    for depth, (tag, names) in enumerate(path):
        shown = "div" if hidden and tag in TELLING else tag
        found[f"in:{shown}"] = None
        if depth == len(path) - 1:
            found[f"tag:{shown}"] = None
        hints = _hints(names)
        found.update(dict.fromkeys(f"hint:{h}" for h in hints))
        if shown in APART or hints & APART_HINTS:
            deepest = "apart"
        elif shown in ("article", "main") or "main" in hints:
            deepest = "main"
    found[f"deepest:{deepest}"] = None  # which kind of container is the innermost
    return tuple(found)


def _hints(names: str) -> set[str]:
    words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower())
    return {_HINT_OF[w] for w in words if w in _HINT_OF}


def under_talk(blocks: list[Block]) -> list[bool]:
    """Whether a block is, or stands under, a short heading about comments.

    A heading reaches to the end of its parent element, or to another heading of its level or above.
    """
    out, reach = [], None  # the parent's path and the level
    for block in blocks:
        heads = [k for k, (tag, _) in enumerate(block.ancestors) if tag in HEADINGS]
        if reach and block.ancestors[: len(reach[0])] != reach[0]:
            reach = None
        if heads:
            level = int(block.ancestors[heads[-1]][0][1])
            if block.text.count(" ") < 8 and _TALK.search(block.text):
                reach = (block.ancestors[: heads[-1]], level)
            elif reach and level <= reach[1]:
                reach = None
        out.append(reach is not None)
    return out


def features_of(blocks: list[Block], hidden: bool = False) -> list[list[str]]:
    """Names of the binary features of each block."""
    out = []
    for i, (block, talk) in enumerate(zip(blocks, under_talk(blocks), strict=True)):
        names = ["bias", *_path_features(block.ancestors, hidden)]
        words = block.text.count(" ") + 1
        share = block.linked / max(1, len(block.text) - words + 1)
        names.append("links:" + ("no" if share == 0 else "some" if share < 0.5 else "most"))
        names.append("words:" + ("1" if words < 2 else "4" if words < 5 else "12" if words < 13 else "40" if words < 41 else "many"))
        if block.text[-1] in ".!?…:;\"'”»":
            names.append("stopped")
        if words <= 40 and _BOILER.search(block.text):
            names.append("boiler")
        if words <= 12 and _COMMENTED.search(block.text):
            names.append("commented")
        if talk:
            names.append("talk")
        if i == 0:
            names.append("first")
        if i == len(blocks) - 1:
            names.append("last")
        out.append(names)
    return out


# The random field


@dataclass(frozen=True)
class Crf:
    """Two labels: 0 boilerplate, 1 main text."""

    weights: dict[str, float]  # of label 1, against 0
    steps: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels of a chain, by Viterbi."""
        if not rows:
            return []
        get, ((a00, a01), (a10, a11)) = self.weights.get, self.steps
        zero, one, back = 0.0, 0.0, []
        for i, names in enumerate(rows):
            score = 0.0
            for name in names:
                score += get(name, 0.0)
            if i:
                to_zero, to_one = zero + a00 >= one + a10, one + a11 >= zero + a01
                zero, one = (
                    zero + a00 if to_zero else one + a10,
                    one + a11 if to_one else zero + a01,
                )
                back.append((0 if to_zero else 1, 1 if to_one else 0))
            one += score
        label = 1 if one > zero else 0
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def train_crf(chains: list[tuple[list[list[str]], list[int]]]) -> Crf:
    """Maximise the likelihood of labelled chains, by gradient ascent over all of them at once.

    ``chains`` is bounded: at most SAMPLE pages of TRAINED_BLOCKS blocks, and the layouts kept here.
    """
    chains = [(rows[:TRAINED_BLOCKS], labels[:TRAINED_BLOCKS]) for rows, labels in chains if rows]
    names = sorted({n for rows, _ in chains for row in rows for n in row})
    place = {n: i for i, n in enumerate(names)}
    length = max((len(rows) for rows, _ in chains), default=0)
    count = len(chains)
    x = np.zeros((length, count, len(names)), dtype=np.float32)
    y = np.zeros((length, count), dtype=np.int64)
    live = np.zeros((length, count), dtype=bool)
    for c, (rows, labels) in enumerate(chains):
        for t, (row, label) in enumerate(zip(rows, labels, strict=True)):
            x[t, c, [place[n] for n in row]] = 1.0
            y[t, c], live[t, c] = label, True
    weights, steps = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((2, 2)), np.zeros((2, 2))]
    total = max(1, int(live.sum()))
    for round_ in range(1, ROUNDS + 1 if count else 1):
        at_one, pairs = _expectations(x @ weights.astype(np.float32), steps, live)
        slope = np.einsum("tcf,tc->f", x, np.where(live, (y == 1) - at_one, 0.0)) / total - RIDGE * weights
        seen = np.zeros((2, 2))
        both = live[1:] & live[:-1]
        np.add.at(seen, (y[:-1][both], y[1:][both]), 1)
        step_slope = (seen - pairs) / total - RIDGE * steps
        for value, gradient, k in ((weights, slope, 0), (steps, step_slope, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * gradient
            moments[k + 1] = 0.999 * moments[k + 1] + 0.001 * gradient**2
            value += (
                RATE * (moments[k] / (1 - 0.9**round_))
                / (np.sqrt(moments[k + 1] / (1 - 0.999**round_)) + 1e-8)
            )
    return Crf(
        dict(zip(names, weights.tolist(), strict=True)),
        tuple(tuple(row) for row in steps.tolist()),
    )


def _expectations(scores: np.ndarray, steps: np.ndarray, live: np.ndarray):
    """Forward-backward: chance of label 1 at each place, and expected transitions."""
    length, count = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], axis=-1).astype(np.float64)
    forward, backward = np.zeros((length, count, 2)), np.zeros((length, count, 2))
    forward[0] = emit[0]
    for t in range(1, length):
        into = np.logaddexp(forward[t - 1, :, :1] + steps[0], forward[t - 1, :, 1:] + steps[1]) + emit[t]
        forward[t] = np.where(live[t][:, None], into, forward[t - 1])
    for t in range(length - 2, -1, -1):
        ahead = emit[t + 1] + backward[t + 1]
        out = np.logaddexp(steps[:, 0] + ahead[:, :1], steps[:, 1] + ahead[:, 1:])
        backward[t] = np.where(live[t + 1][:, None], out, backward[t + 1])
    norm = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    at_one = np.exp(forward[:, :, 1] + backward[:, :, 1] - norm)
    joint = (
        forward[:-1, :, :, None] + steps + (emit + backward)[1:, :, None, :] - norm[None, :, None, None]
    )
    pairs = np.where((live[1:] & live[:-1])[:, :, None, None], np.exp(np.minimum(joint, 0.0)), 0.0)
    return at_one, pairs.sum(axis=(0, 1))


# Labelled pages

def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by the page's own article or main element; None where it has neither."""
    if not any(tag in ("article", "main") for b in blocks for tag, _ in b.ancestors):
        return None
    return [int(_is_main(b)) for b in blocks]


def _is_main(block: Block) -> bool:
    if block.marked is not None:
        return block.marked
    inside = False
    for tag, names in block.ancestors:
        inside |= tag in ("article", "main")
        if inside and (tag in APART or _hints(names) & APART_HINTS):
            return False
    return inside


def _layout(frame: str) -> list[tuple[list[list[str]], list[int]]]:
    blocks = blocks_of(frame)
    labels = [int(bool(b.marked)) for b in blocks]
    return [(features_of(blocks, hidden), labels) for hidden in (False, True)]


_PROSE = (
    "The river rose during the night, and by morning the lower fields were under water.",
    "Nobody in the village could remember such a spring.",
    "In the weeks that followed, the council met twice, and both times it put off the decision about the dam, which had been promised for years and never built.",
    "It rained.",
)
_SOME = "".join(f"<p>{p}</p>" for p in _PROSE)

#: Annotated layouts: data-main="1" marks main text, "0" takes a part out of it.
LAYOUTS = (
    f"<body><header class='site-header'><a href=/>The Daily</a></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav><main data-main=1><h1>After the flood</h1>{_SOME}<aside data-main=0 class=related><h3>Related</h3><a>More floods</a></aside></main><footer>© The Daily. All rights reserved.</footer></body>",
    f"<body><div class=cookie-notice><p>We use cookies to improve this site.</p><button>Accept</button></div><div id=menu><a>Home</a> <a>About</a></div><div class=post-content data-main=1><h2>After the flood</h2>{_SOME}<ul><li>One boat was lost.</li><li>Two were found.</li></ul></div><div id=comments><h3>2 comments</h3><div class=comment><p>Anna says:</p><p>I was there and it was worse than this.</p></div><div class=comment><p>Ben wrote:</p><p>Thank you for the report.</p></div></div><div class=footer>Copyright 2020</div></body>",
    f"<body><article data-main=1><header><h1>After the flood</h1></header>{_SOME}<div class=share-buttons data-main=0><a>Share</a><a>Tweet</a></div><section class=comments data-main=0><h3>Comments</h3><p>Carl: I do not agree with a word of this.</p><p>Dora replied: nor do I.</p></section></article><form><label>Sign up for our newsletter</label><button>Subscribe</button></form></body>",
    f"<body><table><tr><td class=sidebar><a>Archive</a><br><a>Links</a><td class=content><div data-main=1><h1>After the flood</h1>{_SOME}<blockquote>We shall see, said the mayor.</blockquote></div></table><p class=copyright>© 2001 the author</p></body>",
    f"<body><nav><a>Home</a></nav><div class=ad>Buy one, get one free at the corner shop.</div><article data-main=1><h1>After the flood</h1>{_SOME}<div class=advertisement data-main=0><p>Advertisement</p><p>New boots for wet days.</p></div>{_SOME}<table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>3.1 m</td></tr></table><pre>level = 3.1</pre></article><aside class=sidebar><h4>Popular</h4><ul><li><a>Ten walks</a></li></ul></aside><footer><p>&copy; here &middot; all there is.</p></footer></body>",
    f"<body><div role=navigation><a>Start</a></div><div id=main><div class=breadcrumb><a>Start</a> / <a>News</a></div><section data-main=1><h1>After the flood</h1><p>By the editors</p>{_SOME}<figure><img src=x><figcaption>The lower fields.</figcaption></figure></section><div class=newsletter><p>Get our newsletter every Friday.</p></div></div><div class=popup><p>Please log in to read on.</p></div></body>",
    f"<body><div><a>Home</a> <a>Contact</a></div><div data-main=1><p>{_PROSE[0]}</p><p>{_PROSE[2]}</p><p>{_PROSE[1]} <a>Read the record</a>.</p></div><div><a>Imprint</a> <a>Privacy policy</a></div></body>",
    f"<body><header><h2>Notes</h2><p>A site about rivers.</p></header><article data-main=1><h1>After</h1><p>Be.</p>{_SOME}<h2>Later</h2>{_SOME}</article><section id=respond class=comment-respond><h3>Leave a reply</h3><form><textarea></textarea></form></section><div class=comments-area><p>Eve says: a fine piece.</p></div><footer class=site-footer>Made by hand.</footer></body>",
    f"<body><article class=post data-main=1><h1>After the flood</h1><p class=byline>By Fay Green</p>{_SOME}<aside data-main=0><p>A pull quote.</p></aside><div class=ad data-main=0>Shop at the corner.</div><p>That was all.</p><section id=comments data-main=0><h2>Comments</h2><p>A great piece, thanks!</p><p>I saw it too, from the bridge, and it was a sight.</p></section></article><div class=login-form>Log in</div></body>",
    f"<body><article><div data-main=1><h1>After the flood</h1>{_SOME}</div><div><h2>Responses</h2><p>I saw it from the bridge, and it was a sight to see.</p><p>My cellar is still wet.</p></div></article><div>All rights reserved</div></body>",
    f"<body><main><div data-main=1><h1>After the flood</h1>{_SOME}<h2>What the readers of the river gauge saw that night on the bridge</h2>{_SOME}</div><section><h3>12 replies</h3><div><p>Gus: it was not the dam.</p><p>It has never been the dam, as anybody can see who has walked there.</p></div></section></main></body>",
    f"<body><div data-main=1><h1>After the flood</h1>{_SOME}</div><div><h3>Join the discussion</h3><div><p>We lost two boats and a shed, and nobody called.</p></div><div><p>So did we.</p></div></div></body>",
)


def fit(pages: DataFrame, *, sample: int = SAMPLE) -> Crf:
    """Train on at most ``sample`` pages of the table with an article of their own, and LAYOUTS.

    The pages with the smallest hashes are taken, with as many of their blocks as TRAINED_BLOCKS.
    """
    key = F.xxhash64(F.col("page_id").cast("string"), F.substring("html", 1, 200))
    heads = (
        pages.where(F.col("html").isNotNull() & F.lower("html").rlike("<(article|main)\\b"))
        .select(key.alias("key"), "page_id", "html")
        .where(F.length("html") <= 200_000)  # a training page, not one to extract from
    )
    cut = heads.select("key", "page_id").orderBy("key", "page_id").limit(sample)
    last = cut.agg(F.max("key").alias("k"), F.count("*").alias("n")).first()
    chosen = heads.where(F.col("key") <= last.k).orderBy("key", "page_id").limit(sample) if last.n else heads.limit(0)
    chains = [chain for frame in LAYOUTS for chain in _layout(frame)] * LAYOUT_WEIGHT
    for i, row in enumerate(chosen.toLocalIterator()):
        blocks = blocks_of(row.html)
        labels = marked_labels(blocks)
        if labels:
            chains.append((features_of(blocks, hidden=i % 2 == 1), labels))
    return train_crf(chains)


def main_text(page: str, model: Crf) -> str:
    blocks = blocks_of(page)
    labels = model.decode(features_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def extract(pages: DataFrame, model: Crf | None = None, *, carry: dict[str, Column] | None = None) -> DataFrame:
    """Carried columns (page_id, url) and ``text``, the main text of the whole html.

    Null and empty pages give an empty text, and so do pages of boilerplate only. Every row comes
    back; repeated pages are extracted alike; other columns are left out.
    """
    carried = carry if carry is not None else {"page_id": F.col("page_id"), "url": F.col("url")}
    spread = pages.sparkSession.sparkContext.broadcast(model if model is not None else fit(pages))

    def work(texts: list[str]) -> list:
        crf = spread.value
        return [[main_text(page, crf) if page else "" for page in texts]]

    return per_document(pages, work, "text string", text="html", carry=carried, binary=False)
