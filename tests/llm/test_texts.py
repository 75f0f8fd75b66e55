"""Decontamination, personal data, classifiers, packing, chat and urls against brute force, round trips and held-out rows."""

import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from skerry.llm.chat_format import ChatTemplate
from skerry.llm.crf import Crf, train
from skerry.llm.labelled import any_rows
from skerry.llm.decontaminate import SuffixAutomaton, decontaminate, find_contamination, normal_words
from skerry.llm.packing import pack, plan_packing, reduce_by_dominance, tokenizer
from skerry.llm.pii import KINDS, _windows, all_spans, base_spans, redacted, trained
from skerry.llm.queries import oracle_sql, queries
from skerry.llm.quality import ftrl
from skerry.llm.toxicity import nnpu
from skerry.llm.url_filter import Rule, build_cascade, is_listed, judge_urls
from tests.conftest import ROOT, SF
from tests.llm import brute
from tests.test_queries import TABLES, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    want = con.sql(oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(want.columns, want.fetchall())


def test_automaton_against_all_windows():
    rng = random.Random(3)
    for _ in range(200):
        text = lambda n: " ".join(rng.choice("ab") + rng.choice("xy") for _ in range(rng.randint(0, n)))
        items = [(k, text(9)) for k in range(6)]
        docs = [(k, text(40)) for k in range(4)]
        automaton = SuffixAutomaton([(str(i), normal_words(t)) for i, t in items], 4)
        want = brute.contamination(docs, items, 4)
        for d, t in docs:
            spans, found = automaton.scan(normal_words(t))
            assert (sum(b - a for a, b in spans), sorted(automaton.names[k] for k in found)) == want[d][1:]


@pytest.mark.parametrize("most", [1_000_000, 60])
def test_contamination_with_one_or_many_automata(spark, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 10)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in find_contamination(docs, items, max_words=most).collect()}
    assert got == want and any(v[1] for v in got.values())


def test_decontaminated_texts_hold_no_window(spark):
    passage = "One two three, four five six. Seven eight nine ten eleven!"
    docs = spark.createDataFrame([(1, f"Before it. {passage} After it, more words follow here, and more, and more still.", 5), (2, passage, 5), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3} and got[1]["text"] == "Before it. ! After it, more words follow here, and more, and more still."
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[3]["n_chars"] == 5


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.findall("[0-9]", m[0])]
            doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("a.@1+ -(0b29é%") for _ in range(rng.randint(0, 50))) for _ in range(5000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert all(base_spans(t) == plain_base(t) for t in texts)
    assert base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


def test_the_field_adds_spans_and_leaves_prose_alone():
    crf = trained()
    found = lambda t: [(k, t[a:b]) for k, a, b in all_spans([t], crf)[0][1]]
    assert found("please call (017) 555-7713 tonight") == [("phone", "(017) 555-7713")]
    assert found("write to bob (at) corp.example.org, thanks") == [("email", "bob (at) corp.example.org")]
    assert found("we met at noon. At last the 3 dots on 2024-01-02 cost 3.14") == []
    assert redacted("a x@y.zz b", [("email", 2, 8)]) == "a [EMAIL] b"


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    crf = Crf({"x": 1, "y": 2}, np.vstack([np.zeros(3), rng.normal(size=(2, 3))]), rng.normal(size=(3, 3)), rng.normal(size=3))
    sequences = [[["x"], ["y"], ["x", "y"], ["?"]], [["y"]], [["x"], ["x"], ["y"]]]
    for s, got in zip(sequences, crf.viterbi([(len(s), iter(s)) for s in sequences], most=4)):
        emit = [sum(crf.emit[crf.known.get(f, 0)] for f in fs) for fs in s]
        score = lambda p: crf.start[p[0]] + sum(emit[i][t] for i, t in enumerate(p)) + sum(crf.change[a, b] for a, b in zip(p, p[1:]))
        best = max(np.ndindex(*[3] * len(s)), key=score)
        assert tuple(got) == best


def test_the_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    sequences = [[["x"], ["y"], ["x", "y"]], [["y"], ["x"]], [["y"]]]
    tags = [[0, 1, 2], [1, 1], [2]]

    def likelihood(emit, change, start, known):
        total = 0
        for s, own in zip(sequences, tags):
            score = lambda p: start[p[0]] + sum(emit[known[f], t] for fs, t in zip(s, p) for f in fs) + sum(change[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            total += score(own) - np.log(sum(np.exp(score(p)) for p in np.ndindex(*[3] * len(s))))
        return total / len(sequences)

    crf = train(sequences, tags, 3, steps=1, rate=1e-4, l2=0)  # AdaGrad's first step has the sign of the gradient
    zero = [np.zeros_like(p) for p in (crf.emit, crf.change, crf.start)]
    for k, step in enumerate((crf.emit, crf.change, crf.start)):
        for at in np.ndindex(*step.shape):
            if k == 0 and at[0] == 0:
                continue
            ahead, behind = [z.copy() for z in zero], [z.copy() for z in zero]
            ahead[k][at], behind[k][at] = 1e-4, -1e-4
            slope = (likelihood(*ahead, crf.known) - likelihood(*behind, crf.known)) / 2e-4
            assert step[at] == pytest.approx(1e-4 * slope / np.sqrt(1e-6 + slope**2), abs=1e-7)


def test_long_texts_of_numbers_take_little_memory():
    code = """
import resource, numpy as np
from skerry.llm.pii import all_spans, trained
texts = ["call (017) 555-7713 tonight"] * 300 + [" ".join(str(i % 9973) for i in range(20_000))]
crf = trained()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert all(len(s) == 1 for _, s in all_spans(texts, crf)[:300])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT, timeout=300).stdout
    assert float(grown) < 300


def test_tokens_before_a_trigger_are_never_cut():
    long = "a" * 5000
    assert list(_windows(f"x {long} @ y"))[0][:2] == [(0, 1), (2, 5002)]


@pytest.mark.parametrize("name,label,least", [("op4_quality_classifier", "quality", 0.95), ("op7_toxicity", "toxic", 0.75)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    rows = queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    known = rows.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    own = known[known["held_out"]]
    yes, no = own[own[label] == 1]["score"].to_numpy(), own[own[label] == 0]["score"].to_numpy()
    area = ((yes[:, None] > no).sum() + 0.5 * (yes[:, None] == no).sum()) / (len(yes) * len(no))
    assert area >= least
    again = queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    assert (again.sort_values("doc_id")["score"].to_numpy() == rows.sort_values("doc_id")["score"].to_numpy()).all()


def some_rows(n, seed):
    """CSR of n small texts over 40 features, and labels that hang on feature 3."""
    rng = np.random.default_rng(seed)
    own = [np.sort(rng.choice(40, rng.integers(0, 12), replace=False)) for _ in range(n)]
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return ptr, np.concatenate(own), rng.integers(1, 5, ptr[-1]), np.array([int(3 in x or rng.random() < 0.2) for x in own])


def test_ftrl_against_plain_python():
    ptr, ids, counts, y = some_rows(50, 1)
    got = ftrl(ptr, ids, counts, y, bits=6, updates=150, alpha=0.5, beta=1.0, l1=0.1, l2=0.01)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.1 else -(z[i] - math.copysign(0.1, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.01)

    rng = np.random.default_rng(7)
    for _ in range(3):
        for d in rng.permutation(50):
            own = range(ptr[d], ptr[d + 1])
            total = sum(int(counts[k]) for k in own)
            values = {int(ids[k]): math.sqrt(int(counts[k]) / total) for k in own} | {64: 1.0}
            error = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in values.items()))) - int(y[d])
            for i, v in values.items():
                g, w = error * v, weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w
                n[i] += g * g
    assert got.weights == pytest.approx([weight(i) for i in range(64)], abs=1e-9) and got.intercept == pytest.approx(weight(64), abs=1e-9)
    assert 0 < (got.weights != 0).sum() < 40


@pytest.mark.parametrize("prior,l1", [(0.3, 0.001), (0.9, 0.0)])
def test_nnpu_against_plain_python(prior, l1):
    ptr, ids, _, y = some_rows(50, 2)
    steps, rate = 60, 0.05
    got = nnpu(ptr, ids, y, bits=6, prior=prior, steps=steps, rate=rate, l1=l1, min_texts=1, shift=0.5)
    texts = [(int(y[d]), [int(i) for i in ids[ptr[d] : ptr[d + 1]]]) for d in range(50)]
    used = sorted({i for label, own in texts if label == 1 for i in own})
    w, mean, var = dict.fromkeys([*used, "b"], 0.0) | {"b": -2.0}, dict.fromkeys([*used, "b"], 0.0), dict.fromkeys([*used, "b"], 0.0)
    s = lambda x: 1 / (1 + math.exp(-x))
    positive, unlabelled = [own for label, own in texts if label == 1], [own for label, own in texts if label != 1]
    score = lambda own: sum(w[i] for i in own if i in w) + w["b"]
    turned = 0
    for k in range(1, steps + 1):
        loss = lambda g: s(-g)
        rest = sum(loss(-score(u)) for u in unlabelled) / len(unlabelled) - prior * sum(loss(-score(p)) for p in positive) / len(positive)
        turned += rest < 0
        grad = dict.fromkeys(w, 0.0)
        for own, group, weight in [(o, "p", prior / len(positive)) for o in positive] + [(o, "u", 1 / len(unlabelled)) for o in unlabelled]:
            g = score(own)
            up = s(g) * s(-g)  # of l(-g); that of l(g) is its negative
            if group == "p":
                d = weight * (-up - up) if rest >= 0 else weight * up
            else:
                d = weight * up if rest >= 0 else -weight * up
            for i in [*(i for i in own if i in w), "b"]:
                grad[i] += d
        for i in w:
            mean[i] = 0.9 * mean[i] + 0.1 * grad[i]
            var[i] = 0.999 * var[i] + 0.001 * grad[i] ** 2
            w[i] -= rate * (mean[i] / (1 - 0.9**k)) / (math.sqrt(var[i] / (1 - 0.999**k)) + 1e-6)
            if i != "b":
                w[i] = math.copysign(max(0.0, abs(w[i]) - rate * l1), w[i])
    called = min(len(unlabelled) - 1, max(1, round(prior * len(unlabelled))))
    ranked = sorted(map(score, unlabelled), reverse=True)
    intercept = w["b"] - min(0.0, (ranked[called - 1] + ranked[called]) / 2) / 2
    held = [i for i in used if w[i]]
    assert got.ids.tolist() == held and got.weights == pytest.approx([w[i] for i in held], abs=1e-9) and got.intercept == pytest.approx(intercept, abs=1e-9)
    assert prior < 0.5 or turned  # a high prior reaches the correction


def test_training_takes_one_text_an_id_and_unlabelled_ones_outside_the_fold(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(120)] + [(None, "x")], "doc_id long, text string")
    got = [r["text"] for r in any_rows(docs, 1000).collect()]
    want = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    assert len(got) == len(want) and {int(t.split()[1]) % 40 for t in got} == want
    assert 0 < len(any_rows(docs, 7).collect()) <= 7


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["The, the. THE É é× ÷ <|endoftext|> it's 1.5, — naïve e\u0301 \u2003x \x1cy 漢字 ...", "", " ", "a,b.c ,. it'll."]
    raw = [t.encode() for t in texts]
    got = tokenizer(TOKENIZER).ids(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert all(list(g) == own.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts))


@pytest.mark.parametrize("max_plan", [2_000_000, 0])
def test_packing_is_whole_gapless_and_tight(spark, max_plan):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack(docs, TOKENIZER, capacity=512, with_tokens=True, max_plan=max_plan).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["tokens"], "<u4").tobytes()) == r["ids_crc32"] and len(r["tokens"]) == r["length"]
    assert set(by_doc) == {r["doc_id"] for r in docs.collect()}
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == [512 * k for k in range(len(pieces))] and all(r["length"] == 512 for r in pieces[:-1])
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by_bin) <= -(-sum(r["length"] for r in rows) // 512) + 2


def best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((fit if fit is not None else capacity) - x)
    return len(rooms)


def test_plan_against_plain_best_fit():
    rng = random.Random(6)
    for _ in range(200):
        capacity, n = rng.choice([10, 50, 100]), rng.choice([1, 5, 60])
        items = [min(capacity, max(1, int(rng.choice([rng.expovariate(3 / capacity), rng.randint(1, capacity), capacity // 2])))) for _ in range(n)]
        runs, bins = plan_packing(Counter(items), capacity)
        placed = Counter()
        for r in runs:
            for x in range(r.count):
                placed[r.bin + x // r.per_bin] += r.length
        assert len(placed) == bins and max(placed.values()) <= capacity and sum(placed.values()) == sum(items)
        assert -(-sum(items) // capacity) <= bins <= best_fit(items, capacity) + 1


def test_reduction_fixes_only_what_dominates():
    fixed, left = reduce_by_dominance({7: 2, 3: 1, 2: 1, 9: 1}, 10)
    assert (7, 3, 1) in fixed and (9, 0, 1) in fixed and sum(left.values()) + sum(c * (2 if p else 1) for _, p, c in fixed) == 5
    assert reduce_by_dominance({6: 1, 2: 3}, 10)[0] == []  # two twos beside the six beat one


def test_templates_are_checked_and_the_machine_has_arcs():
    with pytest.raises(ValueError):
        ChatTemplate(opening="{role}: ")
    assert ChatTemplate().arcs["user"] == ("assistant",)


def test_cascade_is_exact_over_the_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('key', id) AS key")
    listed = universe.where("substr(key, -2) = '77'")
    levels = build_cascade(universe, listed, n_universe=20_000)
    assert len(levels) > 1
    wrong = universe.where(is_listed(universe["key"], levels) != (universe["key"].substr(-2, 2) == "77"))
    assert wrong.count() == 0
    with pytest.raises(ValueError):
        build_cascade(universe, listed, n_universe=20_000, max_bits=64)


def test_urls_against_rule_by_rule(spark):
    rules = [Rule("org", "/", "allow"), Rule("example.org", "/a", "block"), Rule("x.example.org", "/ab", "allow"), Rule("com", "", "block")]
    rng = random.Random(8)
    urls = [f"https://{rng.choice(['', 'x.', 'y.x.', 'bad'])}example.{rng.choice(['org', 'com', 'net'])}{rng.choice(['', '/', '/a', '/ab/c', '/b?q=/a', '#/a'])}" for _ in range(300)]

    def judge(url):
        host = re.match(r"[^/?#]*", url.split("://", 1)[1])[0]
        path = re.match(r"[^?#]*", url.split("://", 1)[1][len(host) :])[0]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
        return best.key if best else None, best.verdict if best else "allow"

    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {i: judge(u) for i, u in enumerate(urls)}
