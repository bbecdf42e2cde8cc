"""Main text of web pages by equivalence-class template deduction.

A page is read as a sequence of tokens: each start tag with its path from the root (tag names and
class words), so that equal tags in other places are other tokens, and each block of text with the
path at which it begins. For every host, each token's occurrence vector (how often it occurs on each
page) is gathered as page count, total and an order-free fingerprint; tokens of equal vectors are one
equivalence class. A class on most pages of the host nests if its outermost tags all hang below tags
of one other class (the root's class hangs below none); the nested classes of three tokens or more
are the host's template. Blocks of text in it are template text. The rest of the text fills slots, and the
host's main container is the innermost once-per-page tag of the template that holds more than half of it.

On each page the container is taken without template text and without menus, headers, footers, asides, forms,
scripts, notices, adverts and comments (by tag name, role, and words of class and id). The page's own
article or main element is evidence afterwards: it widens a container that it holds, narrows one that
holds it alone, and stands in on pages without the container and on hosts of a single page.

A name of class or id counts if it is such a word, or if most of its words are and the others say no more than
where it stands (``ad-slot-3``, but not ``ad-hoc-query``). Names of the second sort never skip html, body, main,
article, the container or what holds it, and neither sort skips a paragraph, heading, list item or run of text
unless all its names are such words. Paragraphs and headings that a main element holds beside its article belong to
the text; so do articles side by side, where no template says which is meant. Forms, dialogs and tags of which only some names are such words are kept
where they wrap the page (see ``_released``); of an attribute only its own value counts, and ``role="main"`` marks as a main element does. Template text stays where a page's
container would keep less than half of its text, so that copies of a page don't erase each other.

Defined cases: null or empty html gives empty text; a page without a marked container and without a
template slot gives the text of its body; a tag that is never closed ends with its parent or the
page; references that are no references stay as written; a null URL has the host ``""``; a page is read
whole, in a task's memory, however long it is; paths beyond ``LONGEST_PATH`` letters go on from a hash, so that
deep nesting takes memory in proportion; repeated rows are extracted one by one; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acacia.llm.work import written

#: A token counts for the template if it is on this share of a host's pages or more.
SUPPORT = 0.5
#: Tokens of a class that counts as template, and pages that a template text is on at least.
CLASS, REPEATS = 3, 3
#: Letters of a path from which on its hash stands for it.
LONGEST_PATH = 600

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
#: One attribute after another, with its value, so that no word of a value is taken for an attribute.
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MARKING = re.compile(r"class|id|role|hidden", re.I)
_SPLIT = re.compile(r"[\s_-]+")
_SPACE = re.compile(r"\s+")
#: Paths that end in a tag of running text, which is no container.
_TEXT_TAG = r"/(?:p|h[1-6]|li|d[dt]|tr|pre|blockquote|a|b|i|em|strong|span|font|small|u|br|hr|img)(?:[.][^/]*)?$"
_RUNNING = re.compile(r"p$|h[1-6]$|blockquote$")
_LINK = re.compile(r"/a(?:[./]|$)")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_SKIP = frozenset(
    "nav aside footer script style noscript template iframe svg canvas button select option textarea menu head title input audio video".split()
)
#: Tags and roles that are skipped, too, but that some sites wrap whole pages in.
_WRAPS = frozenset("form dialog fieldset".split())
_WRAP_ROLES = frozenset("form dialog alertdialog".split())
#: Words of ``_SKIP_WORDS`` that no wrapper of a page has.
_NO_WRAP = frozenset("ad ads adv advert adverts advertisement advertising cookie cookies consent comment comments reply replies respondent disqus related recommended nav navbar menu footer".split())
#: Words of a class or id that mark what is no main text.
_SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "aside footer masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommended comment comments reply replies respondent disqus pagination pager widget toolbar login".split()
)
#: Words that may stand beside them in a name and mean no more than a place or a part.
_PLACE_WORDS = frozenset(
    "area bar block blocks body bottom box button buttons center column container content count form header icon icons inner item items left link links list main media "
    "module outer panel post posts reader readers right row section side site slot slots text title top unit units user users wrap wrapper".split()
)
#: Tags of running text, which a part of a name doesn't skip.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption pre blockquote a b i em strong span font small u code q cite mark sub sup label".split())
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search alert menu menubar".split())
#: A page header is skipped, an article's own header is not, unless it holds a menu.
_CLOSES = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split())}


class Node:
    """An open tag: its name, path key, whether it and all in it are skipped, whether it is in the container, or in an article.

    Degrees of skipping: 1 by a part of a class name only, 2 by a tag, role or name that may wrap a page, 3 for sure. ``mark`` is the article or main
    that a tag or its role says it is; ``wrap`` is the outermost tag of degree 2 around it, and ``may_wrap`` whether that may be a wrapper.
    """

    __slots__ = ("name", "key", "skipped", "inside", "article", "mark", "wrap", "may_wrap")

    def __init__(self, name: str, key: str, skipped: int, inside: bool, article: bool, mark: str = "", wrap: str = "", may_wrap: bool = False):
        self.name, self.key, self.skipped, self.inside, self.article, self.mark, self.wrap, self.may_wrap = name, key, skipped, inside, article, mark, wrap, may_wrap


def _marks(attributes: str) -> tuple[set[str], set[str], str, bool]:
    """Words of class and id, its whole class names, role, and whether it is hidden."""
    words: set[str] = set()
    whole: set[str] = set()
    role, hidden = "", False
    if attributes and _MARKING.search(attributes):
        seen: set[str] = set()
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name not in ("class", "id", "role", "hidden", "aria-hidden") or name in seen:
                continue
            seen.add(name)  # of an attribute that comes twice, the first counts
            value = html.unescape(a or b or c).lower()
            if name in ("class", "id"):
                words.update(_SPLIT.split(value))
                whole.update(value.split())
            elif name == "role":
                role = value.strip()
            else:
                hidden = hidden or name == "hidden" or value == "true"
    words.discard("")
    return words, whole, role, hidden


def _named(names: set[str]) -> int:
    """How names of class and id skip a tag: 2 if one is a word of what is no main text, 1 if one consists of such words, else 0."""
    if names & _SKIP_WORDS:
        return 2
    for name in names:
        words = [w for w in _SPLIT.split(name) if w]
        skip = sum(w in _SKIP_WORDS for w in words)
        if skip and skip + sum(w in _PLACE_WORDS or w.isdigit() for w in words if w not in _SKIP_WORDS) == len(words) or 2 * skip > len(words):
            return 1
    return 0


def walk(page: str, container: str | None = None, released: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, Node | None]]:
    """("open", name, node), ("break", name, None) at block borders, and ("text", decoded text, node in which it stands)."""
    stack: list[Node] = []
    raw_until = 0
    at = 0
    root = Node("", "", 0, False, False)
    open_now: dict[str, int] = {}

    def top() -> Node:
        return stack[-1] if stack else root

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_now[stack.pop().name] -= 1

    for m in _TAG.finditer(page):
        if m.start() < raw_until:
            continue
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), top()
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, -1, -1) if open_now.get(name) else ():
                if stack[depth].name == name:
                    pop_to(depth)
                    break
                if stack[depth].name in ("article", "main", "body") and name not in ("html", "body", "article", "main"):
                    break
            if name in _BLOCK or name == "br":
                yield "break", name, None
            continue
        if name in _BLOCK:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name == "p" or stack[depth].name in _CLOSES.get(name, ()):
                    pop_to(depth)
                    break
                if stack[depth].name in _BLOCK:
                    break
            yield "break", name, None
        elif name == "br":
            yield "text", " ", top()
        words, whole, role, hidden = _marks(m[3] or m[6] or "")
        above = top()
        path = above.key if len(above.key) <= LONGEST_PATH else "~" + xxhash.xxh64_hexdigest(above.key)
        key = f"{path}/{name}" + "".join("." + w.replace("/", "|") for w in sorted(words)) + (".role=main" if role == "main" else "")
        may_wrap = False
        if name in _SKIP or (name == "header" and not above.article) or role in _SKIP_ROLES or hidden:
            skipped = 3
        elif name in ("html", "body") or key in released or (container is not None and (container + "/").startswith(key + "/")):
            skipped = 0
        elif name in _WRAPS or role in _WRAP_ROLES:
            skipped, may_wrap = 2, True
        elif name in ("article", "main") or name in _TEXT_TAGS:
            skipped = 2 if whole and whole <= _SKIP_WORDS else 0
        else:
            skipped = _named(whole)
            may_wrap = not whole <= _SKIP_WORDS and not whole & _NO_WRAP
        inside = above.inside or (container is not None and key == container)
        mark = name if name in ("article", "main") else "main" if role == "main" else ""
        node = Node(name, key, max(above.skipped, skipped), inside, above.article or mark != "", mark, above.wrap, above.may_wrap)
        if skipped == 2 and above.skipped < 2:
            node.wrap, node.may_wrap = key, may_wrap
        yield "open", name, node
        closed = (m[3] or m[6] or "").endswith("/")
        if name in _RAW and not closed:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = raw_until = end.end() if end else len(page)
            continue
        if name not in _VOID and not closed:
            stack.append(node)
            open_now[name] = open_now.get(name, 0) + 1
    if at < len(page):
        yield "text", html.unescape(page[at:]), top()


def _marked(page: str, slot: str | None = None, released: frozenset[str] = frozenset()) -> tuple[str | None, list[str], bool]:
    """The path of the page's own main container (its first article that is not skipped, else its main, else one skipped by
    a part of a class name), the paths of articles that stand beside each other, and whether ``slot`` is on the page."""
    found: dict[tuple[int, str], str] = {}
    low = page.lower()
    if "<article" not in low and "main" not in low and slot is None:
        return None, [], False
    beside: list[str] = []
    has_slot = False
    for what, _, node in walk(page, None, released):
        if what == "open" and node is not None:
            has_slot = has_slot or node.key == slot
            if node.skipped < 2 and node.mark:
                first = found.setdefault((node.skipped, node.mark), node.key)
                if node.mark == "article" and node.skipped == 0 and not any((node.key + "/").startswith(other + "/") for other in beside):
                    beside.append(node.key)
                if node.key == slot and first == slot:
                    break
    return next((found[k] for k in ((0, "article"), (0, "main"), (1, "article"), (1, "main")) if k in found), None), beside, has_slot


def _released(page: str) -> frozenset[str]:
    """Paths of forms, dialogs and tags with a skipped name beside others that wrap the page: running text is in them, and ten times
    what is outside, or more than that with the page's only article. Wrappers in wrappers are found one after the other."""
    released: frozenset[str] = frozenset()
    while True:
        outside = 0
        held: dict[str, int] = {}
        marks: dict[str, int] = {}
        running: set[str] = set()
        for what, text, node in walk(page, None, released):
            if node is None or node.skipped > 2:
                continue
            if what == "open" and node.may_wrap and node.wrap:
                marks[node.wrap] = marks.get(node.wrap, 0) + (node.mark != "")
                if node.mark or _RUNNING.match(node.name):
                    running.add(node.wrap)
            elif what == "text":
                size = len(text.strip())
                if node.skipped == 0:
                    outside += size
                elif node.wrap and node.may_wrap:
                    held[node.wrap] = held.get(node.wrap, 0) + size
        most = max(((n, path) for path, n in held.items() if path in running), default=(0, ""))
        if not most[0] or not (10 * outside < most[0] or (marks[most[1]] == 1 and outside < most[0])):
            return released
        released |= {most[1]}


def _common(paths: list[str]) -> str:
    """The innermost path that holds all of some paths."""
    steps = [p.split("/") for p in paths]
    n = next((i for i, level in enumerate(zip(*steps)) if len(set(level)) > 1), min(map(len, steps)))
    return "/".join(steps[0][:n])


def _widened(page: str, container: str, released: frozenset[str]) -> str:
    """The main element that holds a container, if all else in it are paragraphs and headings of its own."""
    at = container.find("/main")
    if at < 0 or container.rfind("/") <= at:
        return container
    end = container.find("/", at + 1)
    main = container[:end]
    beside = [path for path, *_ in _blocks(page, main, 0, released) if not (path + "/").startswith(container + "/")]
    return main if beside and all(path.startswith(main + "/") and path[len(main) + 1 :].split(".")[0] in _TEXT_TAGS for path in beside) else container


def _container(page: str, slot: str | None, released: frozenset[str] = frozenset()) -> str | None:
    own, beside, has_slot = _marked(page, slot, released)
    if slot is None or not has_slot:
        chosen = _common(beside) or own if len(beside) > 1 else own
    elif own is None or own == slot:
        chosen = slot
    elif slot.startswith(own + "/"):
        chosen = own
    else:
        chosen = own if own.startswith(slot + "/") and len(beside) < 2 else slot
    return chosen if chosen is None else _widened(page, chosen, released)


def _blocks(page: str, container: str | None = None, upto: int = 0, released: frozenset[str] = frozenset()) -> Iterator[tuple[str, int, str, int]]:
    """Blocks of text in the container that are skipped ``upto`` that degree: path outside links at which it begins, degree, text, characters outside links."""
    parts: list[str] = []
    path, degree, chars = "", 0, 0
    for what, text, node in walk(page, container, released):
        if what == "break":
            block = _SPACE.sub(" ", "".join(parts)).strip()
            if block:
                yield path, degree, block, chars
            parts, path, degree, chars = [], "", 0, 0
        elif what == "text" and node is not None and node.skipped <= upto and (node.inside or container is None):
            parts.append(text)
            size = len(text.strip())
            if size:
                link = _LINK.search(node.key)
                if not chars and not path:
                    path = node.key[: link.start()] if link else node.key
                degree = max(degree, node.skipped)
                chars += 0 if link else size
    block = _SPACE.sub(" ", "".join(parts)).strip()
    if block:
        yield path, degree, block, chars


def _block_token(path: str, block: str) -> int:
    return (xxhash.xxh64_intdigest(f"{path}\n{block}") >> 1) or 1


def extract(page: str | None, slot: str | None = None, template: frozenset[int] = frozenset()) -> str:
    """Blocks of main text, a line each."""
    if not page:
        return ""
    container, released = _container(page, slot), frozenset()
    if container is None:
        released = _released(page)
        container = _container(page, slot, released) if released else None
    blocks = list(_blocks(page, container, 0, released))
    if container is None or not blocks:
        # Parts of class names don't decide where nearly all of the page would go by them.
        wide = list(_blocks(page, container, 1, released))
        if 10 * sum(len(b[2]) for b in blocks) < sum(len(b[2]) for b in wide):
            blocks = wide
    if template:
        rest = [b for b in blocks if _block_token(b[0], b[2]) not in template]
        if 2 * sum(len(b[2]) for b in rest) >= sum(len(b[2]) for b in blocks):
            blocks = rest
    return "\n".join(b[2] for b in blocks)


def _host(url: str | None) -> str:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _tokens(page: str) -> dict[tuple[str, int], list[int]]:
    """Each token (path; block of text or 0): how often it occurs, characters outside links, those skipped by a part of a class name, and how it is skipped."""
    out: dict[tuple[str, int], list[int]] = {("", 0): [1, 0, 0, 0]}
    for what, _, node in walk(page):
        if what == "open" and node is not None:
            row = out.setdefault((node.key, 0), [0, 0, 0, 0])
            row[0] += 1
            row[3] = max(row[3], node.skipped)
    for path, degree, block, chars in _blocks(page, None, 1):
        row = out.setdefault((path, _block_token(path, block)), [0, 0, 0, 0])
        row[0] += 1
        row[1 + degree] += chars
    return out


_VECTOR = "host string, token string, block long, pages long, total long, vector long, chars long, doubtful long, skipped long"


def vectors(pages: DataFrame) -> DataFrame:
    """Occurrence vectors of all tokens of all hosts: page count, total, fingerprint; and their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, str, int], list] = {}
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not page:
                    continue
                host, number = _host(url), xxhash.xxh64_intdigest(url or "")
                for (token, block), (n, chars, doubtful, skipped) in _tokens(page).items():
                    row = rows.setdefault((host, token, block), [0, 0, 0, 0, 0, 0])
                    row[0] += 1
                    row[1] += n
                    row[2] += xxhash.xxh64_intdigest(f"{number}:{n}") >> 28  # sums of 36 bits stay in 64
                    row[3] += chars
                    row[4] += doubtful
                    row[5] = max(row[5], skipped)
            columns = [*([k[i] for k in rows] for i in range(3)), *([v[i] for v in rows.values()] for i in range(6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), *[pa.int64()] * 7), strict=True)], [c.split()[0] for c in _VECTOR.split(", ")])

    sums = pages.select("url", "html").mapInArrow(run, _VECTOR).groupBy("host", "token", "block")
    return sums.agg(*(F.sum(c).alias(c) for c in ("pages", "total", "vector", "chars", "doubtful")), F.max("skipped").alias("skipped"))


def template(profile: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Tokens (host, token, block, ...) of the host's template: those of nested classes on most pages."""
    key = ["host", "pages", "total", "vector"]
    root = profile.where("token = '' and block = 0").select("host", F.col("pages").alias("host_pages"))
    frequent = profile.join(root, "host").where((F.col("pages") >= F.col("host_pages") * F.lit(support)) & (F.col("pages") > 1))
    vector = F.struct("pages", "total", "vector")
    above = frequent.where("block = 0").select("host", F.col("token").alias("above"), vector.alias("outer"))
    parent = F.when(F.col("token") != "", F.regexp_replace("token", "/[^/]*$", ""))
    tags = frequent.where("block = 0").withColumn("above", parent).join(above, ["host", "above"], "left").withColumn("class", vector)
    outermost = F.when(F.col("outer") != F.col("class"), F.col("outer"))
    nests = tags.groupBy(*key).agg(F.min(outermost).alias("low"), F.max(outermost).alias("high")).where("low is null or low = high").select(*key)
    sizes = frequent.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= CLASS)
    return frequent.join(nests, key).join(sizes, key)


def slots(profile: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Each host's main container (null if no tag holds most of the text), and the blocks that are template text."""
    known = written(template(profile, support), "template")
    fixed = known.where((F.col("block") != 0) & (F.col("pages") >= REPEATS))
    data = profile.where("block <> 0 and chars + doubtful > 0").join(fixed.select("host", "block"), ["host", "block"], "left_anti")
    held = data.groupBy("host", "token").agg(F.sum("chars").alias("chars"), F.sum("doubtful").alias("doubtful"))
    steps = F.split("token", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    held = held.select("host", F.explode(prefixes).alias("token"), "chars", "doubtful").groupBy("host", "token").agg(F.sum("chars").alias("chars"), F.sum("doubtful").alias("doubtful"))
    held = written(held, "held")
    whole = held.where("token = ''").select("host", F.when(F.col("chars") * 10 < F.col("doubtful") + F.col("chars"), 1).otherwise(0).alias("upto"), F.col("chars").alias("all_chars"), F.col("doubtful").alias("all_doubtful"))
    once = known.where((F.col("block") == 0) & (F.col("total") == F.col("pages")) & ~F.col("token").rlike(_TEXT_TAG) & (F.col("token") != "")).select("host", "token", "skipped")
    most = (F.col("chars") + F.col("upto") * F.col("doubtful")) * 2 > F.col("all_chars") + F.col("upto") * F.col("all_doubtful")
    best = once.join(held, ["host", "token"]).join(whole, "host").where(most & (F.col("skipped") <= F.col("upto")))
    best = best.groupBy("host").agg(F.max_by("token", F.struct(F.size(F.split("token", "/")), "token")).alias("slot"))
    texts = fixed.groupBy("host").agg(F.sort_array(F.collect_set("block")).alias("texts"))  # no more than twice a page's blocks
    return best.join(texts, "host", "full")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    chosen = written(slots(written(vectors(pages), "vectors")), "slots").select(F.col("host").alias("slot_host"), F.col("slot").alias("__slot"), "texts")
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host")).join(chosen, F.col("host") == F.col("slot_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, s, frozenset(t or ())) for p, s, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return found.select("page_id", "url", "html", "__slot", "texts").mapInArrow(run, "page_id long, url string, text string, n_chars long")
