"""The ratios decide what is chosen, against a plain count; names removed, tags renamed, deep pages."""

import os
import re
import time
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import html_text

SF = "/root/testdata/sf0.01/pages.parquet"


def pages():
    import pyarrow.parquet as pq

    if not os.path.exists(SF):
        pytest.skip("needs the driver's tables")
    return [r["html"] or "" for r in pq.read_table(SF, columns=["html"]).to_pylist()]


def share(of, among):
    size = lambda c: sum(len(k) * n for k, n in c.items())
    return size(of & among) / max(size(of), 1)


def test_scores_decide(monkeypatch):
    html = pages()
    want = [html_text.main_text(x) for x in html]
    monkeypatch.setattr(html_text, "ratios", lambda blocks: (dict.fromkeys((n.path for n, _ in blocks), 1.0), 0.5))
    assert sum(html_text.main_text(x) != w for x, w in zip(html, want, strict=True)) > len(html) / 2


def test_pages_without_article_tags_and_without_names():
    html = pages()
    want = [Counter(html_text.main_text(x).split("\n")) for x in html]
    renamed = [Counter(html_text.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", x)).split("\n")) for x in html]
    assert np.mean([share(w, got) for w, got in zip(want, renamed)]) > 0.99 and np.mean([share(got, w) for w, got in zip(want, renamed)]) > 0.99
    bare = [re.sub(r' (class|id)="[^"]*"', "", re.sub(r"<(/?)(article|main|nav|footer|header|aside)\b", r"<\1div", x)) for x in html]
    got = [Counter(html_text.main_text(x).split("\n")) for x in bare]
    recall, precision = (np.mean([share(a, b) for a, b in pairs]) for pairs in (list(zip(want, got)), list(zip(got, want))))
    print(f"without any names: recall {recall:.3f}, precision {precision:.3f}")
    assert recall > 0.9 and precision > 0.8


def test_ratios_against_a_plain_count():
    page = "<body><div><p>One, two.</p><p>Three.</p></div><ul><li>a</li><li>bb</li></ul><nav>no, no.</nav><h1>T</h1></body>"
    blocks, nodes = html_text.blocks_of(page)
    html_text.number_paths(nodes)
    score, threshold = html_text.ratios(blocks)
    # Paths in page order: p, li, h1; the menu's scores zero.
    characters, marks, total = [(9 + 6) / 2, (1 + 2) / 2, 1], [(2 + 1) / 2, 0, 0], [15, 3, 1]
    smooth = lambda x: [(x[max(k - 1, 0)] + 2 * x[k] + x[min(k + 1, 2)]) / 4 for k in range(3)]
    want = [(c * (1 + m) * t) ** 0.5 for c, m, t in zip(smooth(characters), smooth(marks), total)]
    by_tag = {n.tag: score[n.path] for n, _ in blocks}
    assert [by_tag[t] for t in ("p", "li", "h1")] == pytest.approx(want) and by_tag["nav"] == 0
    assert threshold == pytest.approx(np.std(want))


def test_deep_pages_take_linear_time():
    started = time.time()
    n = 100_000
    assert html_text.main_text("<div>" * n + "<p>Hello there, all of you.</p>" + "</section>" * n) == "Hello there, all of you."
    text = html_text.main_text("".join(f"<div class=c{k}><b>Text {k}, here." for k in range(n)))
    assert text.count("\n") == n - 1
    assert html_text.main_text("<span>" * n + "x" + "</p>" * n) == "x"
    assert time.time() - started < 60
