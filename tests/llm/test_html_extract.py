import random

from foliograph.llm import html_extract as h


def text(page, **known):
    return h.main_text(page, h.Template(**({"main": ""} | known)))


def test_markup():
    assert text("<p>a<b>b</b>c</p>d") == "abc d"
    assert text("<p>a &amp; b&nbsp;c &lt;i&gt; &#233;&copy x</p>") == "a & b c <i> é© x"
    assert text("<!-- <p>no</p> --><p>x<!-- unclosed") == "x"
    assert text("<script>var t='<p>no</p>'</script><style>p{}</style><p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text("<p>a<p>b<br>c<li>d<li>e") == "a b c d e"
    assert text("<div title='a>b' data-x=\"</div>\">in</div>") == "in"
    assert text("<nav>n</nav><header>h</header><div class='main-sidebar'>s</div><div id=cookieNotice>c</div><form>f</form><section class=comments>r</section><p>x</p><footer>f</footer>") == "x"
    assert text("<p class='broken\">x</p>") == text("<p class='broken\">x</p>")  # ends
    assert text("") == "" and text("plain") == "plain" and text("<") == "<"
    assert text("<nav><ul><li>a</nav><p>x") == "x"
    assert text("<article><header><h1>T</h1><p>by me</p></header><p>x</article>") == "T x"


def test_without_a_template_all_text_returns():
    page = "<body><nav>n</nav><p>x</p><footer>f</footer></body>"
    assert h.main_text(page, None) == "n x f" and h.main_text(page, h.own_template(page)) == "x"


STORY = " ".join(["alpha beta gamma"] * 20)


def test_marks_do_not_lose_articles():
    for page in (
        f"<body><form id=f><div class=x><h1>T</h1><p>{STORY}</p></div></form></body>",
        f"<body><div class='content has-sidebar'><h1>T</h1><p>{STORY}</p></div></body>",
        f"<body><nav><a href=/>home</a></nav><div id=search-page><h1>T</h1><p>{STORY}</p></div><footer>f</footer></body>",
    ):
        assert h.main_text(page, h.own_template(page)) == f"T {STORY}"


def site(n, seed=1):
    """Pages of one template without telling tags or names: links, a story with a line of its own on every page, the end; texts differ."""
    rng = random.Random(seed)
    pages = []
    words = lambda k: " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(k))
    for i in range(n):
        story = [words(30) for _ in range(1 + i % 4)]
        links = "".join(f"<li><a href=/{k}>link {rng.randrange(99)}</a></li>" for k in range(2 + i % 3))
        more = "<div class=z><p>Read on</p></div>" if i % 3 == 0 else ""
        page = f"<html><body><div class=u><ul>{links}</ul></div><div class=v><div class=w><h1>t{i}</h1><p>Thanks for being here</p>{''.join(f'<p>{s}</p>' for s in story)}</div></div><div class=x>bye {i} {words(3)}</div>{more}</body></html>"
        pages.append((page, " ".join([f"t{i}", *story])))
    return pages


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, path long")


def test_template_finds_the_unmarked_slot(spark):
    pages = site(40)
    rows = [(i, f"http://s.org/{i}", p) for i, (p, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in h.extract(frame(spark, rows).repartition(3)).collect()}
    assert got == {i: t for i, (_, t) in enumerate(pages)}


def brute_force(pages):
    """The template by whole occurrence vectors of a host's pages, each class checked on each page by itself and with each other."""
    pages = sorted(set(pages))
    each = [h.structure(p) for p in pages]
    count = {}
    for n, (tokens, _) in enumerate(each):
        for t in tokens:
            count.setdefault((t.path, t.key), [0] * len(pages))[n] = t.times
    held = {k: sum(map(bool, v)) for k, v in count.items()}
    count = {k: v for k, v in count.items() if held[k] >= (h.FREQUENT if not k[1] else max(h.NEARLY_ALL, h.SUPPORT / len(pages))) * len(pages)}
    groups = {}
    for k, v in count.items():
        groups.setdefault(tuple(v), []).append(k)
    spans = []  # of each page: class -> places of its events
    for tokens, events in each:
        own = [((tokens[e if e >= 0 else -e - 1].path, tokens[e if e >= 0 else -e - 1].key), e >= 0) for e in events]
        spans.append({v: [(i, e) for i, e in enumerate(own) if e[0] in members] for v, members in groups.items()})

    def occurrences(page, v):
        size = sum(1 if k[1] else 2 for k in groups[v])
        at = [i for i, _ in spans[page][v]]
        return [at[i : i + size] for i in range(0, len(at), size)]

    def ordered(page, v):
        size = sum(1 if k[1] else 2 for k in groups[v])
        seen = [e for _, e in spans[page][v]]
        first = next(s[v][:size] for s in spans if s[v])
        return all(seen[i : i + size] == [e for _, e in first] for i in range(0, len(seen), size))

    ranks = sorted(groups, key=lambda v: (-sum(map(bool, v)), -len(groups[v])))
    valid = [v for v in ranks if all(ordered(p, v) for p in range(len(pages)))]
    crossing = lambda a, b: any(x[0] < y[0] < x[-1] < y[-1] or y[0] < x[0] < y[-1] < x[-1] for x in a for y in b)
    good = []
    for v in valid:
        if not any(crossing(occurrences(p, v), occurrences(p, w)) for w in good for p in range(len(pages))):
            good.append(v)
    skeleton = [k for v in good for k in groups[v] if held[k] >= h.NEARLY_ALL * len(pages) and sum(v) == held[k]]
    texts = sorted(k[1] for v in good for k in groups[v] if k[1])
    sums = lambda path: sum(t.plain for tokens, _ in each for t in tokens if t.path == path and not t.key) - sum(t.plain for tokens, _ in each for t in tokens if t.key in texts and (t.path + "/").startswith(path + "/"))
    holding = [k[0] for k in skeleton if not k[1] and sums(k[0]) >= h.MAIN * sums("")]
    return max(holding, key=lambda p: p.count("/")), texts


def test_brute_force(spark):
    for seed in range(3):
        pages = [p for p, _ in site(14 + seed, seed)]
        main, texts = brute_force(pages)
        rows = frame(spark, [(i, "http://s.org/", p) for i, p in enumerate(pages + pages[:3])])
        got = h.templates(rows.select(h.host_of(rows.url).alias("host"), "html")).collect()
        assert [(r.host, r.main, r.texts) for r in got] == [("s.org", main, texts)]
        assert main.endswith("/div.w") and len(texts) == 1


def test_vectors_and_validity_decide():
    pages = [p for p, _ in site(12)]
    each = [h.structure(p) for p in pages]
    names = {k for tokens, _ in each for t in tokens if not t.key for k in [(t.path, 0)]}
    at = lambda k: [next((t.times for t in tokens if (t.path, t.key) == k), 0) for tokens, _ in each]
    first = lambda k: sum(next((t.first for t in tokens if (t.path, t.key) == k), 0) for tokens, _ in each)
    tokens = [h.Token(*k, sum(map(bool, at(k))), sum(at(k)), hash(tuple(at(k))), 100, 0, 100, False, first(k)) for k in names]

    def found(tokens):
        own = h.classes(tokens)
        orders = [h.order_of([(t.path, t.key) for t in c]) for c in own]
        place = {(t.path, t.key): (c, n) for c, members in enumerate(own) for n, t in enumerate(members)}
        rows = {}
        for page, events in each:
            spots = [place.get((t.path, t.key)) for t in page]
            kept = [(spots[e if e >= 0 else -e - 1], e >= 0) for e in events if spots[e if e >= 0 else -e - 1]]
            for c, around in h.fits([(s[0], s[1] if o else -s[1] - 1) for s, o in kept], orders).items():
                key = (c, *(around or (None, None)))
                rows[key] = rows.get(key, 0) + 1
        return h.template(tokens, own, h.nested_in([(*k, n) for k, n in rows.items()]))

    assert found(tokens).main is not None
    assert found([t._replace(vector=0) for t in tokens]).main is None  # one class of all, which no page keeps in order


def test_fits():
    a, b = h.order_of([("/a", 0), ("/a/b", 0)]), h.order_of([("/c", 0)])
    assert a == [0, 1, -2, -1] and b == [0, -1]
    orders = [a, b]
    assert h.fits([(0, 0), (1, 0), (1, -1), (0, 1), (0, -2), (0, -1)], orders) == {0: (-1, 0), 1: (0, 1)}
    assert h.fits([(0, 0), (0, -1)], orders) == {0: None}
    assert h.fits([(0, 0), (1, 0), (0, 1), (1, -1), (0, -2), (0, -1)], orders) == {0: (-1, 0), 1: None}
    assert h.fits([(1, 0), (1, -1), (1, 0)], orders) == {1: None}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "no host", ""), (3, "http://a.org/", "<article><h1>T</h1><p>x</p></article>"), (3, "http://a.org/", "<article><h1>T</h1><p>x</p></article>"), (None, "http://b.org", "<p>" + "long " * 50000), (4, "http://A.ORG/2", "<div>other layout</div>")]
    got = sorted((str(r.page_id), r.text[:40], r.n_chars) for r in h.extract(frame(spark, rows)).collect())
    assert got == sorted([("1", "", 0), ("2", "", 0), ("3", "T x", 3), ("3", "T x", 3), ("None", ("long " * 8).strip()[:40].ljust(40), 249999), ("4", "other layout", 12)])
    assert h.extract(frame(spark, rows).where("false")).count() == 0


def test_order_and_copies_do_not_matter(spark):
    rows = [(i, "http://s.org/", p) for i, (p, _) in enumerate(site(20, 2))]
    a = {r.page_id: r.text for r in h.extract(frame(spark, rows)).collect()}
    b = {r.page_id: r.text for r in h.extract(frame(spark, rows[::-1] + [rows[4]] * 60).repartition(7)).collect()}
    assert a == b


def test_deep_markup_is_linear():
    """Unclosed elements, tags that close nothing, nested marks and long class names: time and paths grow with the page, not with its square."""
    import time

    def took(page):
        began = time.process_time()
        tokens, events = h.structure(page)
        assert sum(len(t.path) for t in tokens) < 120 * len(page) and len(events) < len(page)
        h.main_text(page, h.own_template(page))
        return time.process_time() - began

    for piece in ("<div>x", "<b>x</i>", "<nav class=menu>x", "<li><b>x</u>", "<p><b><br>", "<ul><li>x</p>"):
        small, large = piece * 4000, piece * 16000
        assert took(large) < 8 * took(small) + 1
    assert took("".join(f"<div class='{'w' * 50} {i}'>" for i in range(3000))) < 5


def test_deep_text_is_kept():
    deep = "<body><article><p>top</p>" + "<div>" * 300 + "<p>bottom</p>" + "</div>" * 300 + "</article><footer>f</footer></body>"
    assert h.main_text(deep, h.own_template(deep)) == "top bottom"
    assert len(h.structure("<div>" * 10_000 + "x")[0]) == 10_002
