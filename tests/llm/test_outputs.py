"""Packing, record files, page text, url verdicts and the pipeline."""

import os
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexigrain.llm import html_template, packing, records, url_filter
from lexigrain.llm.tokens import tokenizer_path

TEXTS = [None, "", " ", "one", "two words\n\nand more", "café déjà vu", "x" * 3000] + [
    " ".join(f"w{(i * k) % 997}" for k in range(i * 7 % 300)) for i in range(60)
] + [" ".join(f"long{i}" for i in range(6000))]


def text_docs(spark, extra="offset int, file string"):
    rows = [(i * 3, t, 7, "x") for i, t in enumerate(TEXTS)] + [(9, TEXTS[3], 7, "x"), (None, "no id", 7, "x")]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(5), rows


def plain_ids(name, end, texts):
    plain = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids + [end] for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_hold_every_id_once_in_windows_without_gaps(spark):
    docs, rows = text_docs(spark)
    got = packing.pack(docs, window=64, open_windows=3, least_piece=4).toPandas()
    ids = plain_ids("byte_bpe_50k.json", 0, [r[1] for r in rows])
    want = sorted((-1 if r[0] is None else r[0], zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids))
    of_id = {}
    for r, x in zip(rows, ids):
        of_id.setdefault(r[0], x)
    assert got.length.sum() == sum(map(len, ids)) and len(want) == len(rows)
    for key, group in got.groupby("doc_id"):
        x = of_id[int(key)]
        times = 2 if key == 9 else 1
        cover = np.zeros(len(x), int)
        for p in group.itertuples():
            assert p.doc_tokens == len(x)
            assert p.ids_crc32 == zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes())
            cover[p.start : p.start + p.length] += 1
        assert (cover == times).all()
    for _, window in got.sort_values("offset").groupby("sequence_id"):
        assert window.offset.tolist() == (window.length.cumsum() - window.length).tolist()
        assert window.length.sum() <= 64
    assert 1 - got.length.sum() / (64 * got.sequence_id.nunique()) < 0.06
    assert packing.pack(docs.limit(0)).count() == 0


def test_checksums_of_frames():
    # check value of the Castagnoli polynomial
    assert records.crc32c_many([b"123456789"]) == [0xE3069283]
    rng = np.random.default_rng(0)
    blobs = [rng.bytes(n) for n in (0, 1, 3, 4, 5, 255, 256, 257, 5000)]
    assert records.crc32c_many(blobs) == [records._crc32c_short(b) for b in blobs]
    framed = records.frames(blobs)
    assert records.payloads(framed) == blobs
    for damaged in (framed[5][:-1], framed[5][:20] + b"?" + framed[5][21:], b"?" + framed[5][1:], b""):
        with pytest.raises(ValueError):
            records.payloads([damaged])


def test_record_files_round_trip(spark, tmp_path):
    docs, rows = text_docs(spark)
    folder = str(tmp_path / "out")
    index = records.write_records(docs, folder, file_bytes=20_000)
    got = records.read_records(index.orderBy(F.rand(3)), folder).join(index.select("file", "ordinal", "before"), ["file", "ordinal"])
    got = got.join(records.file_starts(index), "file").withColumn("start", F.col("file_start") + F.col("before")).toPandas()
    got = got.sort_values("start")
    ids = plain_ids("word_bpe_49k.json", 1, [r[1] for r in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    assert got.n_tokens.tolist() == [len(ids[i]) for i in order]
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(ids[i], "<u4").tobytes()) for i in order]
    assert got.start.tolist() == np.cumsum([0] + [len(ids[i]) for i in order])[:-1].tolist()
    assert [None if pd.isna(x) else int(x) for x in got.doc_id] == [rows[i][0] for i in order]
    assert set(os.listdir(folder)) - {f".{n}.crc" for n in os.listdir(folder)} >= set(got.file)
    assert records.write_records(docs.limit(0), folder).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style>
<script>var t="</p><article>no</article>";</script></head><body><header><h2>Site name</h2></header>
<div class="menu"><ul><li><a href="/a">Home<li><a href="/b">{link}</a></ul></div>
<div id="content"><article><header><h1>{title}</h1></header><p>First&nbsp;&amp; <b>bold
line<br>goes  on<p>Second &#8212; {text}<aside>side</aside>
<div class="share">Share {text}</div><div class="box">Read more here</div>
<ul><li>point {text}<li>other</ul><table><tr><td>cell {text}<td>next {text}</table></article>
<section class="comments"><article><p>Nice {text}!</p></article></section></div>
<form><input value="x">Send</form><!-- <p>hidden</p> --><footer>&copy; {title}</footer></body></html>"""
WANTED = "{title}\nFirst & bold line goes on\nSecond \u2014 {text}\npoint {text}\nother\ncell {text}\nnext {text}"


def test_page_text_without_what_is_around_it(spark):
    rows = []
    for i in range(8):
        values = {"title": f"Title {i}", "link": f"Link {i}", "text": f"text{i}"}
        rows.append((i, f"https://h.example/{i}", PAGE.format(**values), "h", WANTED.format(**values)))
    rows.append((20, "https://alone.example/x", "<body><nav>menu</nav><div>Only <i>page</i></div><p>a &lt; b <p>c</body", "h", "Only page\na < b\nc"))
    rows += [(21, None, None, "h", ""), (22, "no url", "", "h", ""), (None, "https://h.example/0", "plain text & more", "h", "plain text & more")]
    rows.append((23, "https://deep.example/", "<div>" * 2000 + "deep" + "</div>" * 5, "h", "deep"))
    rows.append((24, "https://deep.example/", "<p>" + "word " * 30_000 + "<", "h", ("word " * 30_000).strip() + " <"))
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, want string").repartition(3)
    got = html_template.extract(pages).collect()
    want = {r[0]: r[4] for r in rows}
    assert len(got) == len(rows)
    for row in got:
        assert row.text == want[row.page_id], row.page_id
        assert row.n_chars == len(row.text)
    assert html_template.extract(pages.limit(0)).count() == 0


def test_template_classes_nest(spark):
    pages = spark.createDataFrame(
        [(f"h", i, f"<body><div class=top><p>a{i}</div>" + "<ul><li>x</ul>" * (i % 3) + "</body>") for i in range(9)],
        "host string, page long, html string",
    )
    found = html_template.deduce(html_template.page_tokens(pages)).collect()
    groups = {}
    for row in found:
        groups.setdefault(row["class"], set()).add(row.label)
    assert sorted(map(sorted, groups.values())) == [["body", "div.top", "p"], ["li", "ul"]]
    body = next(row["class"] for row in found if row.label == "body")
    assert {row.around for row in found if row.label in ("ul", "li")} == {body}
    assert not any(row.fixed for row in found)  # the list's text is there as often as the list


def plain_template(pages):
    """Classes, the class around each, and fixed slots, from whole occurrence vectors."""
    vectors, parent, own, label = {}, {}, {}, {}
    for i, page in enumerate(pages):
        blocks, nodes = html_template.blocks_of(page)
        trail, text = [], {}
        for block in blocks:
            words = html_template.clean(block.texts)
            if words:
                text.setdefault(block.path[-1].path, []).append(words)
        whole = tuple(map(tuple, text.values()))
        for node in nodes:
            while trail and trail[-1].depth >= node.depth:
                trail.pop()
            parent[node.path] = trail[-1].path if trail else 0
            trail.append(node)
            label[node.path] = (node.depth, node.path)
            vectors.setdefault(node.path, {}).setdefault(i, [0, whole])[0] += 1
        for node in nodes:
            own.setdefault(node.path, {})[i] = tuple(text.get(node.path, ()))
    groups = {}
    for path, vector in vectors.items():
        if len({w for _, w in vector.values()}) >= 3:
            groups.setdefault(tuple((i, n) for i, (n, _) in vector.items()), []).append(path)
    classes = {min(g, key=label.get): g for g in groups.values() if len(g) >= 2}
    of = {p: c for c, g in classes.items() for p in g}
    out = {}
    for top, group in classes.items():
        for path in group:
            texts = set(own[path].values())
            out[path] = (top, of.get(parent[top]), len(texts) == 1 and texts != {()})
    return out


LAYOUTS = [
    "<body><div class=a><h1>T{0}</h1><p>x{0}</p><b>same</b></div><div class=q><p>All rights</p></div></body>",
    "<body><section><h2>S{0}</h2><div class=w>fixed words</div><ul><li>i{0}<li>j{0}</ul></section></body>",
    "<table><tr><td>c{0}<td class=k>key</table>tail {0}",
]


def test_template_equals_whole_occurrence_vectors(spark):
    pages = [LAYOUTS[i % 3].format(i // 2) + "<dl><dt>x<dd>y</dl>" * (i % 2) for i in range(24)]
    rows = [("h", i, p) for i, p in enumerate(pages)] + [("one", 100, pages[0])]
    table = spark.createDataFrame(rows, "host string, page long, html string").repartition(3)
    found = html_template.deduce(html_template.page_tokens(table)).collect()
    want = plain_template(pages)
    assert {r.path: (r["class"], r.around, r.fixed) for r in found if r.host == "h"} == want
    assert sum(f for _, _, f in want.values()) >= 3 and not [r for r in found if r.host == "one"]


def texts_of(spark, pages):
    rows = [(i, f"https://h.example/{i}", p) for i, p in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in html_template.extract(table).orderBy("page_id").collect()]


def test_copies_of_an_article_keep_their_text(spark):
    copy = "<body><h2>Head</h2><p>one</p><ul><li>item</ul><blockquote>quoted</blockquote></body>"
    got = texts_of(spark, [copy] * 5 + ["<body><p>other</p></body>"])
    assert got == ["Head\none\nitem\nquoted"] * 5 + ["other"]


def test_lead_and_story_and_three_layouts_on_one_host(spark):
    lead = "<body><div class=lead>Lead {0}</div><div class=story><p>Story {0}</p></div><div class=x>Same on all</div></body>"
    assert texts_of(spark, [lead.format(i) for i in range(6)]) == [f"Lead {i}\nStory {i}" for i in range(6)]
    got = texts_of(spark, [LAYOUTS[i % 3].format(i) for i in range(18)])
    want = ["T{0}\nx{0}", "S{0}\ni{0}\nj{0}", "c{0}\ntail {0}"]
    assert got == [want[i % 3].format(i) for i in range(18)]


def test_url_verdicts(spark):
    cases = {
        "http://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/1?q#f": ("a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://b.example.com/en/1": ("b.example.com", "/en/1", "example.com/en/", "block"),
        "http://b.example.com/en": ("b.example.com", "/en", "com/", "allow"),
        "http://bexample.com/en/x": ("bexample.com", "/en/x", "com/", "allow"),
        "http://x.net/fr/?a": ("x.net", "/fr/", "net/fr/", "block"),
        "http://x.net/de/": ("x.net", "/de/", None, "allow"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://x.com?u=http://y.net/es/": ("x.com", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "x.net/fr/1": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "h", "r") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "h", "r"), (None, None, "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    for row in got:
        url = rows[row.page_id][1] if row.page_id is not None else None
        assert (row.host, row.path, row.rule, row.verdict) == cases[url], url
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_templates_with_blocked_pages_are_rejected(spark):
    rules = [("block", "h.org", f"/ads/{i}x") for i in range(20)] + [("allow", "h.org", "/news/")]
    urls = [f"http://h.org/ads/{i}x" for i in range(20)] + [f"http://h.org/ads/{i}y" for i in range(20)]
    urls += [f"http://h.org/news/{i}/a/b" for i in range(20)] + ["http://h.org/about"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules=rules).collect()}
    assert all(got[i].verdict == "block" for i in range(40))
    assert all(got[i].verdict == "allow" for i in range(40, 61))
    assert got[45].template == "/news/*/a/b"


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones += [h >> b & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def smallest_of_groups(docs):
    prints, ids = [plain_print(t) for t in docs.text], docs.doc_id.tolist()
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    smallest = {}
    for x, i in zip(label, ids):
        smallest[x] = min(smallest.get(x, i), i)
    return sorted(smallest.values())


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    docs, kept = documents, documents.toPandas()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.persisted(stage(spark, docs, folder), name)
        assert docs.columns == documents.columns
        had, kept = kept, docs.toPandas()
        assert set(kept.doc_id) <= set(had.doc_id)
        if name == "language":
            assert len(kept) >= 0.98 * len(had)
        if name == "quality":
            known = pd.read_parquet(f"{folder}/labels.parquet").merge(had, on="doc_id")
            good = known[known.quality == 1].doc_id
            assert good.isin(kept.doc_id).mean() > 0.9
            assert not known[known.quality == 0].doc_id.isin(kept.doc_id).all()
        if name == "near_copies":
            assert sorted(kept.doc_id) == smallest_of_groups(had)
        if name == "mixing":
            words = kept.text.str.split().str.len().sum()
            assert abs(words - had.text.str.split().str.len().sum()) <= had.source.nunique()
    pieces = corpus_pipeline.run(spark, folder).toPandas()
    ids = plain_ids("byte_bpe_50k.json", 0, kept.text)
    assert pieces.length.sum() == sum(map(len, ids))
    assert set(pieces.doc_id) == set(kept.doc_id)


def test_near_copies_stage_keeps_rows_without_id_and_one_of_repeated_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A B C"), (None, "a b c"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 3]
