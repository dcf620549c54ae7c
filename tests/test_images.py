import json
import random

from hearthline.sources import images

CDN = "https://images.finncdn.no/dynamic/"


def pages(spark, *html):
    return spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id int, html string")


def found(spark, *html):
    out = {}
    for r in images.gallery(pages(spark, *html)).orderBy("page_id", "pos").collect():
        out.setdefault(r.page_id, []).append(r.url)
    return out


def script(node, kind="application/ld+json"):
    return f"<script type='{kind}'>{json.dumps(node, ensure_ascii=False)}</script>"


def walk(node, key=None):
    """Strings that count, in reading order, by plain recursion."""
    if key is not None and any(w in key.lower() for w in images.BLOCKED):
        return []
    if isinstance(node, dict):
        return [s for k, v in node.items() for s in walk(v, k)]
    if isinstance(node, list):
        return [s for v in node for s in walk(v)]
    return [node] if isinstance(node, str) and (key is None or any(w in key.lower() for w in images.KEYS)) else []


def test_walk_equals_recursion(spark):
    rng = random.Random(6)
    keys = ["image", "Url", "logoImage", "data", "mediaList", "b", "zoo", "a", "navUrl", "photos"]

    def node(depth):
        kind = rng.random()
        if depth > 6 or kind < 0.4:
            return rng.choice([f"s{rng.randrange(99)}", 7, None, True, '{"image": "no"}', "[1]", 'q"x', 1.5, {}, []])
        return {k: node(depth + 1) for k in rng.sample(keys, rng.randint(0, 5))} if kind < 0.75 else [node(depth + 1) for _ in range(rng.randint(0, 4))]

    documents = [node(0) for _ in range(120)]
    rows = [(i, 0, [0], json.dumps(d)) for i, d in enumerate(documents)]
    df = spark.createDataFrame(rows, "page_id int, phase int, path array<int>, value string")
    got = {}
    for r in sorted(images.json_strings(df, "page_id").collect(), key=lambda r: (r.page_id, r.path)):
        got.setdefault(r.page_id, []).append(r.value)
    assert got == {i: s for i, d in enumerate(documents) if (s := walk(d) if not isinstance(d, str) else [d])}
    assert max(len(s) for s in got.values()) > 5


def test_gallery(spark):
    deep = {"@graph": [[{"offer": {"image": [f"{CDN}480w/2024/1_a.jpg?x=1", {"url": f"//images.finncdn.no/dynamic/1600w/2024/1_a.jpg"}], "logo": f"{CDN}1600w/l/x.jpg"}}]], "name": f"{CDN}1600w/2024/no.jpg"}
    state = "<script>window.state = " + json.dumps({"photos": [f"{CDN}960w/2024/b.png"], "agent": {"image": f"{CDN}960w/2024/c.png"}}) + ";</script>"
    text = f"<img src='{CDN}320w/2024/small.jpg'><img src=\"{CDN}1280w/2024/d.webp\"><a href='https://other.no/dynamic/1600w/e.jpg'></a><img src='{CDN}800w/2024/b.png?q=1'>"
    got = found(spark, script(deep) + state + text, script({"image": "broken"})[:-12] + "<p>", None, "", "<script>{not json}</script>")
    assert got == {0: [f"{CDN}1600w/2024/1_a.jpg", f"{CDN}960w/2024/b.png", f"{CDN}1600w/l/x.jpg", f"{CDN}1600w/2024/no.jpg", f"{CDN}960w/2024/c.png", f"{CDN}1280w/2024/d.webp"]}


def test_identities(spark):
    urls = [f"{CDN}1600w/a/b/pic-3.jpg", f"{CDN}w800/a/b/pic_ff.jpg", f"{CDN}default/b/original/pic.jpg", "https://x.no/", f"{CDN}480x320/.jpg", "https://x.no/a%20b/c.png"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", images.identity(images.F.col("u")).alias("d")).orderBy("i").collect()
    host = "images.finncdn.no"
    assert [(r.d.key, r.d.width) for r in rows] == [(f"{host}/b/pic", 1600), (f"{host}/b/pic", 800), (f"{host}/b/pic", 0), (None, 0), (f"{host}/480x320/.jpg", 480), ("x.no/a b/c", 0)]
