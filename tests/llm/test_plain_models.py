"""Link-graph values on random graphs, and the language model's fit, against plain linear algebra."""

import random

import numpy as np
import pytest

from emberlog.llm import language_id, url_filter


@pytest.mark.parametrize("seed", range(3))
def test_trust_and_distrust_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 14
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org', 'info'])}" for i in range(n)]
    rows = []
    for page in range(70):
        at = rng.randrange(n)
        targets = rng.sample(hosts, rng.randrange(4))
        path = rng.choice(["/en/1", "/de/2", "/es/3", "/x"])
        rows.append((page, f"http://{hosts[at]}{path}", " ".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{t}/y">' for t in targets)))
    settings = url_filter.Settings(tolerance=1e-9)
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), settings=settings).collect()
    count = np.zeros((n, n))
    allowed, blocked, pages = (np.zeros(n) for _ in range(3))
    verdict = {r.page_id: (r.rule, r.verdict) for r in got}
    for page, url, html in rows:
        src = hosts.index(url.split("/")[2])
        pages[src] += 1
        rule, v = verdict[page]
        allowed[src] += rule is not None and v == "allow"
        blocked[src] += rule is not None and v == "block"
        for t in {h.split("/")[0] for h in html.replace('"', " ").replace(">", " ").split("//")[1:]}:
            dst = hosts.index(t.strip())
            count[src, dst] += dst != src
    share = lambda c: np.divide(c, c.sum(1, keepdims=True), out=np.zeros_like(c), where=c.sum(1, keepdims=True) > 0)
    spread = lambda c, s: np.linalg.solve(np.eye(n) - settings.damping * share(c).T, s)
    seeds = lambda x: np.divide(x, pages, out=np.zeros(n), where=pages > 0)
    trust, distrust = spread(count, seeds(allowed)), spread(count.T, seeds(blocked))
    for r in got:
        i = hosts.index(r.host)
        assert abs(r.trust - trust[i]) < 1e-6 and abs(r.distrust - distrust[i]) < 1e-6
        if r.rule is None:
            assert r.verdict == ("block" if distrust[i] - trust[i] > settings.threshold else "allow")


def test_language_model_against_a_plain_fit():
    rng = random.Random(5)
    stems = {"en": ["the", "and", "this", "with", "house"], "de": ["der", "und", "nicht", "mit", "haus"], "es": ["el", "los", "que", "con", "casa"]}
    text = lambda lang, k=12: " ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "n"]) for _ in range(k))
    labels = [lang for lang in stems for _ in range(20)]
    texts = [text(lang) for lang in labels]
    mark = [i % 20 < 6 for i in range(60)]
    s = language_id.Settings()
    model = language_id.Classifier(s, texts, labels, mark)
    grams = lambda t: set(language_id._grams(t).tolist())
    chosen = [grams(t) for t, m in zip(texts, mark) if m]
    kernel = lambda ts: np.array([[len(grams(t) & c) / np.sqrt(max(1, len(grams(t))) * len(c)) for c in chosen] for t in ts])
    values, vectors = np.linalg.eigh(kernel([t for t, m in zip(texts, mark) if m]))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    x = kernel(texts) @ root
    langs = sorted(stems)
    y = np.array([[1.0 if lang == other else -1.0 for other in langs] for lang in labels])
    weight = np.array([1 / labels.count(lang) for lang in labels])
    w = np.linalg.solve((x.T * weight) @ x + s.ridge * np.eye(x.shape[1]), (x.T * weight) @ y)
    new = [text(lang, 9) for lang in langs for _ in range(10)] + ["", "zzz qqq"]
    plain = kernel(new) @ root @ w
    got, score, known = model.predict(new)
    assert [langs[i] for i in plain.argmax(1)] == got or np.sort(plain, 1)[:, -1].min() - np.sort(plain, 1)[:, -2].min() < 1e-3
    assert np.allclose(score, np.clip((plain.max(1) + 1) / 2, 0, 1), atol=2e-3)
    every = set().union(*chosen)
    assert np.allclose(known, [len(grams(t) & every) / max(1, len(grams(t))) for t in new], atol=1e-6)
    assert [g for g, lang in zip(got, [lang for lang in langs for _ in range(10)]) if g == lang] == [lang for lang in langs for _ in range(10)]
