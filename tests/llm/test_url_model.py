"""The URL model on sites that it hasn't seen, and on urls without a host."""

import math

from boxloom.llm import url_filter as uf


def blocked(url, w):
    own = uf._buckets(*uf._split(url), 14, (3, 4, 5))
    return 1 / (1 + math.exp(-(w[own].sum() / math.sqrt(max(1, len(own))) + w[-1]))) >= 0.5


def test_held_out_sites():
    """Five folds by site: names share no more than their parts with those of the training table."""
    sites = [(s, 1) for s in uf.UNWANTED_SITES] + [(s, 0) for s in uf.WANTED_SITES]
    right = {(y, p): 0 for y in (0, 1) for p in (False, True)}
    for fold in range(5):
        out = [x for i, x in enumerate(sites) if i % 5 == fold]
        w = uf.train_url_model([(u, y) for u, y in uf.LABELLED if not any(s in u for s, _ in out)])
        for site, y in out:
            right[y, blocked(f"http://www.{site}.com/about", w)] += 1
    precision, recall = right[1, True] / (right[1, True] + right[0, True]), right[1, True] / (right[1, True] + right[1, False])
    assert precision >= 0.85 and recall >= 0.4


def test_other_hosts_and_paths():
    w = uf.train_url_model()
    assert all(blocked(u, w) for u in ("https://casino-win.example.net/en/4470", "http://cheap-pills.shop.example/x?y=1", "http://m.free-bets.test/"))
    assert not any(blocked(u, w) for u in ("", "no scheme", "https://m.thersh.example.org/de/6194?page=2", "http://library.test/books", "https://blog.tionsh.example.com/en/5844.html"))
