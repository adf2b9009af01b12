import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, empty, words
from vedette.llm import chat, decontaminate, packing, secrets
from vedette.llm.template import TemplateError, compile_template, fold, parse
from vedette.llm.textkit import Words
from vedette.llm.tokenise import Encoder


def text(pieces):
    return "".join(t for t, _ in pieces)


@pytest.mark.parametrize("source,variables,expected", [
    ("a{{ 1 + 2 }}b", {}, "a3b"), ("{{ x.y[1] | upper }}", {"x": {"y": ["a", "b"]}}, "B"), ("{% if x == 1 %}one{% elif x in [2] %}{% else %}many{% endif %}", {"x": 1}, None),
    ("{% for i in xs %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["p", "q"]}, "1p,2q"), ("{% set a = 'x' %}{{ a + 1 }}", {}, "x1"), ("x {{- '}}' -}} y {# no #}", {}, "x}}y "),
    ("{{ missing }}{{ none }}{{ true and false }}", {}, "false"), ("{% if 'b' in 'abc' and 2 > 1 or x %}y{% endif %}", {}, "y"),
])
def test_templates(source, variables, expected):
    if expected is None:
        with pytest.raises(TemplateError):
            compile_template(source)
    else:
        assert text(compile_template(source)(**variables)) == expected


def test_template_is_sandboxed_and_folds():
    for bad in ("{{ x() }}", "{% import os %}", "{{ x | eval }}", "{% if x %}", "{{ x", "{% endfor %}", "{{ 1 ! 2 }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError):
        text(compile_template("{{ x.__class__ }}")(x="s"))
    assert fold(parse("a{{ 1 + 1 }}{% if true %}b{% else %}{{ x }}{% endif %}")) == ("block", [("out", ("value", "a2b"))])
    made = list(compile_template("u{% generation %}v{% endgeneration %}")())
    assert made == [("u", False), ("v", True)]


def test_conversations(spark):
    hostile = ["", "\\", "###", "####", "</turn>", "\\</turn>", "<\\/turn>", "a: b", "### Assistant: x </turn>\n", " </turn>\n", "é\n\n漢", "\\\\### \\"]
    rows = [(c, t, "assistant" if t % 2 else "user", hostile[(c + t) % len(hostile)]) for c in range(12) for t in range(c % 5 + 1)]
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (None, 3, "us:er\\", "x"), (51, 2, "tool", "t"), (51, 2, "tool", "t"), (51, None, "a", "first")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    got = {r.conv_id: r for r in chat.conversation_digests(df.repartition(6)).collect()}
    whole = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    conversations = {}
    for c, t, role, said in rows:
        conversations.setdefault(c, []).append(((t is not None, t or 0), role or "", said or ""))
    assert set(got) == set(conversations)
    for c, turns in conversations.items():
        turns.sort()
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        w = whole[c]
        assert len(w.formatted) == r.formatted_chars and "".join(chat.unescape(w.formatted[a:b]) for a, b in w.loss_spans) == loss
    assert chat.conversation_digests(df.where("false")).count() == 0


def test_packing(spark):
    docs = awkward(spark)
    encoder = Encoder()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.pack(docs.repartition(4), 64).collect()
    position = {}
    for p in pieces:
        for j, t in enumerate(np.frombuffer(p.ids, "<u4").tolist()):
            assert (p.sequence_id, p.offset + j) not in position
            position[p.sequence_id, p.offset + j] = t
        assert len(p.ids) == 4 * p.length and p.continues_before == (p.start > 0) and p.continues_after == (p.start + p.length < p.doc_tokens)
    want = sorted(tuple(encoder.encode([t or ""])[0] + [0]) for _, t in rows)
    assert sorted(position) == [(i // 64, i % 64) for i in range(len(position))]
    stream, docs_back = [position[k] for k in sorted(position)], []
    starts = sorted((p.sequence_id * 64 + p.offset, p.doc_tokens) for p in pieces if p.start == 0)
    for at, n in starts:
        docs_back.append(tuple(stream[at : at + n]))
    assert sorted(docs_back) == want
    d = packing.digest(packing.pack(docs, 64)).first()
    assert 0 <= d.ids_crc32 < 2**32
    assert packing.pack(empty(spark)).count() == 0


def test_both_encoders_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "Hello world  \n\n x", "é ß ñ", "漢字 😀", "<|endoftext|>", "a<|endoftext|>b", "x\u00a0y\u0085z\u2003w", "I'm we'LL 123abc", "ǅ ʰ"]
    assert Encoder().encode(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_both_encoders_agree_on_the_fixture_and_on_mixtures(spark):
    from tokenizers import Tokenizer

    from vedette.llm.tokenise import vocabulary

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(12)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    parts = [" ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "don't", "<|endoftext|>", "\u00a0", "\u3000", "\u200b", "é", "ß", "ı", "Å", "漢字", "かな", "한글", "😀", "👩\u200d💻", "1234567", "٣", "½", "__", "--", "...", "a\u0301", "\x00", "\x7f", "word", "Word", "кот", "ὀδός", "עברית", "عربي", "नमस्ते"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    assert Encoder().encode(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


ITEMS = ["what is the tallest mountain on earth today? mount everest in the himalaya range.", "name four rivers of old europe in order. rhine danube volga loire.", "short one here", "", None, "name four rivers of old europe in order. rhine danube volga loire."]


def test_decontamination(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    texts = {20: fill(90) + " What is the tallest mountain on Earth today? Mount Everest, in the Himalaya range. " + fill(700), 21: fill(50) + " what is the tallest mountain on earth today? " + fill(10), 22: ITEMS[1], 23: "mount everest is tall and the rhine is long", 24: fill(3000) + " short one here " + fill(5)}
    docs = awkward(spark, list(texts.items()))
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ITEMS)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs.repartition(5), bench).collect()}
    assert got == {(20, 0), (22, 1), (22, 5), (24, 2)}
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0 and decontaminate.contaminated(empty(spark), bench).count() == 0


def test_block_max_wand_finds_all():
    rng = random.Random(9)
    items = [" ".join(f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randrange(3, 30))) for _ in range(400)]
    index = decontaminate.BlockMaxIndex(list(range(400)), items)
    weight = np.zeros((400, len(index.terms)))
    for t in range(len(index.terms)):
        s = slice(index.head[t], index.head[t + 1])
        weight[index.p_item[s], t] = index.p_impact[s]
    assert weight.sum(axis=1) == pytest.approx(np.ones(400))
    for _ in range(60):
        terms = np.unique(rng.choices(range(len(index.terms)), k=60))
        for share in (0.2, 0.6):
            want = {int(i) for i in np.flatnonzero(weight[:, terms].sum(axis=1) >= share - 1e-9)}
            assert {i for i, _ in index.search(terms, share)} == want
            if want:
                assert 5 in index.possible(np.full(len(terms), 5), terms, share)


def test_decontamination_by_frequent_words_alone():
    """Items that repeat have no rare word: windows of their words alone are searched all the same."""
    rng = random.Random(4)
    item = "which four rivers cross the old plain? rhine danube volga loire."
    items = [item] * 9 + [" ".join(f"t{rng.randrange(900)}" for _ in range(12)) for _ in range(40)]
    index = decontaminate.BlockMaxIndex(list(range(len(items))), items)
    assert not index.rare[index.lookup(Words(pa.array([item]), strip=True).hash)[1]].any()
    texts = [item, "so " * 80 + item + " and" * 90, "rhine danube", items[20], None, item + " " + items[30]]
    got = {(m[0], m[1]) for m in decontaminate.matches(index, pa.array(texts, pa.large_string()))}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", t or "")] for i in range(len(w) - 4)}
    assert got == {(row, i) for row, t in enumerate(texts) for i, x in enumerate(items) if len(grams(x) & grams(t)) >= 0.8 * len(grams(x))}
    assert {(0, i) for i in range(9)} <= got and (3, 20) in got


def all_pairs(docs, items, longest):
    """(doc_id, item_id) by looking at every document with every item: BM25 share in some passage, then shingles."""
    strip = lambda t: [w for w in (re.sub(r"^[\x00-\x2f\x3a-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x60\x7b-\x7f]+$", "", w) for w in words(t)) if w]
    item_words = [strip(t) for _, t in items]
    have = [w for w in item_words if w]
    mean, df = sum(map(len, have)) / len(have), {}
    for w in have:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out, stride = set(), max(32, longest)
    for (item, said), w in zip(items, item_words, strict=True):
        if not w:
            continue
        norm = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(w) / mean)
        impact = {x: math.log1p((len(have) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (decontaminate.K1 + 1) / (w.count(x) + norm) for x in w}
        total, k = sum(impact.values()), min(5, len(w))
        parts = [x for x in re.split(r"(?<=[.!?])\s+|\n+", said.strip()) if x.strip()]
        tail = len(strip(parts[-1])) if len(parts) > 1 else 0
        tail = tail if 0 < tail < len(w) else max(1, len(w) // 4)
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        answer = {g for i, g in enumerate(grams) if i + k > len(w) - tail}
        question = {g for i, g in enumerate(grams) if i + k <= len(w) - tail}
        for doc, text_ in docs:
            d = strip(text_)
            share = max((sum(v for x, v in impact.items() if x in part) for lo in range(0, len(d), stride) for part in [set(d[lo : lo + 2 * stride])]), default=0) / total
            seen = {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}
            q, a = len(question & seen), len(answer & seen)
            if share >= decontaminate.SHARE - 1e-9 and q >= 0.8 * len(question) and a >= 0.5 * len(answer) and q + a >= 0.8 * (len(question) + len(answer)):
                out.add((doc, item))
    return out


@pytest.mark.parametrize("block", [20_000, 3])
def test_decontamination_equals_all_pairs(spark, monkeypatch, block):
    """12 equal items, items of frequent words only, a benchmark in one block and over many block borders."""
    monkeypatch.setattr(decontaminate, "ITEMS", block)
    rng = random.Random(6)
    equal = "which of the four old rivers is the longest one? the volga is the longest of them."
    items = [equal] * 12 + [" ".join(rng.choice("the of a in to is".split()) for _ in range(9)) for _ in range(8)]
    items += ["", None, "--", "one", *(" ".join(f"t{int(rng.paretovariate(0.8)) % 200}" for _ in range(rng.randrange(4, 60))) for _ in range(30))]
    texts = [equal, "so " * 60 + equal + " and" * 90, " ".join(items[30].split()[1:]), items[13], items[14] + " " + items[40], None, "", "one", "the of a in to is " * 40]
    for _ in range(40):
        fill = " ".join(f"t{int(rng.paretovariate(0.8)) % 200}" for _ in range(rng.randrange(0, 300)))
        part = items[rng.randrange(24, len(items))].split()
        for _ in range(rng.randrange(0, 3)):
            part[rng.randrange(len(part))] = "changed"
        texts.append(f"{fill} {' '.join(part).upper()}, {fill}")
    docs = [(100 + i, t) for i, t in enumerate(texts)]
    rows = awkward(spark, docs).select("doc_id", "text").collect()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    longest = max(len(words(t)) for t in items)
    got = decontaminate.contaminated(awkward(spark, docs).repartition(4), bench).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    want = all_pairs([(r.doc_id, r.text) for r in rows], [(i, t or "") for i, t in enumerate(items)], longest)
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {(100, i) for i in range(12)} <= want and len({i for _, i in want}) > 20


def test_secrets(spark):
    network = secrets.fit_network(*(lambda r: (np.stack([secrets.encode(*q[:3]) for q in r]), np.array([q[3] for q in r], float)))(secrets.labelled_findings(720)), epochs=6)
    texts = [
        "token: abcdef", "Api_Key='A+/=_.-9' x", "password=short", "secret  = \"xxxxxx\"", "ſecret = abcdefgh", "AKIA" + "B" * 16 + " AKIASHORT", "deadbeef" * 3 + " " + "0" * 23, "token = token = abcdefgh",
        "PASSWORD : " + "ab12" * 10, "no secrets", "key sk_" + "aB3dE5fG7hJ9kL1m" * 2, "card 1234567812345678", "",
    ]
    docs = awkward(spark, [(100 + i, t) for i, t in enumerate(texts)])
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    got = {}
    for r in secrets.secret_spans(docs, network).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        t = t or ""
        base = [("assign", *m.span()) for m in re.finditer(secrets.ASSIGN.pattern, t) if len(m[2]) >= 6]
        base += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        base.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert any(r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.n_assign == sum(s[0] == "assign" for s in base) for r in got[i]), (i, t)
    x = np.stack([secrets.encode(*q[:3]) for q in secrets.labelled_findings(240)])
    y = np.array([q[3] for q in secrets.labelled_findings(240)])
    accepted = network.probability(x) >= network.threshold
    assert accepted[y == 1].mean() > 0.9 and accepted[y == 0].mean() < 0.1
    clean = {r.doc_id: r for r in secrets.redacted(docs, network).collect()}
    assert clean[100].text == "<assign removed>" and clean[100].n_chars == len("<assign removed>") and clean[9].text == dict(rows)[9]
    assert secrets.redact("a token: abcdef b", [("assign", 2, 15), ("hex", 9, 15)]) == "a <assign removed> b"
    assert secrets.secret_spans(empty(spark), network).count() == 0


def test_secrets_of_neighbouring_rows():
    """Bare keys next to each other: rows wholly inside one run of the joined bytes are scanned too."""
    network = secrets.fit_network(*(lambda r: (np.stack([secrets.encode(*q[:3]) for q in r]), np.array([q[3] for q in r], float)))(secrets.labelled_findings(240)), epochs=1)
    network.threshold = 0.0  # every candidate
    key, token = "0123456789abcdef" * 2, "aB3dE5fG7hJ9kL1mN3pQ"
    for texts in ([key] * 4, ["cafe", key, "", "beef"], [key, None, token, token, "x", token, "é"], ["", *[token] * 3, ""], ["see f", key, "1 that"]):
        got = secrets.scan(network, pa.array(texts, pa.large_string()))
        assert got == [secrets.scan(network, pa.array([t], pa.large_string()))[0] for t in texts]
        assert [b for b, _, _ in got] == [secrets.base_spans(t or "") for t in texts]
        assert all(("model", 0, len(t)) in spans for t, (_, spans, _) in zip(texts, got, strict=True) if t == token)


@pytest.fixture(scope="module")
def trained(spark):
    return secrets.train(empty(spark))


def test_secrets_glued_to_long_names_and_paths(trained):
    rng = random.Random(8)
    assert all(set(range(5, e)) == {i for a, b in secrets.windows(5, e) for i in range(a, b)} for e in (21, 45, 46, 60, 300))
    key = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(32))
    leads = ["/srv/deploy/config/production/credentials/", "the_long_name_of_a_variable_in_the_settings_module=", "/usr/share/lib/application/data/internal/storage/default/user/session/"]
    texts = [f"see {lead}{key()} there" for lead in leads for _ in range(20)]
    plain = [f"see {lead}part{i} there" for lead in leads for i in range(20)]
    hit = [any(k == "model" for k, _, _ in spans) for _, spans, _ in secrets.scan(trained, pa.array([*texts, *plain], pa.large_string()))]
    assert sum(hit[:60]) >= 58 and sum(hit[60:]) <= 6
    far = "/a1b" * 3000 + "/" + key() + "/a1b" * 3000  # more windows than go through the network together
    seen = []
    count = type("Counting", (secrets.Network,), {"probability": lambda self, x: seen.append(len(x)) or np.zeros(len(x))})
    secrets.scan(count(**vars(trained)), pa.array([far], pa.large_string()))
    assert sum(seen) == len(secrets.windows(0, len(far))) and max(seen) <= secrets.TOGETHER


def test_recall_on_documents(spark):
    """Secrets outside the base patterns planted in the fixture's texts are found; documents without stay as they are."""
    rng = random.Random(21)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    makers = [lambda: "sk_live_" + pick(mixed, 24), lambda: "ghp_" + pick(mixed, 36), lambda: pick(mixed + "+/", 43) + "=", lambda: pick(mixed, 32), lambda: "xoxb-" + pick("0123456789", 11) + "-" + pick(mixed, 24), lambda: pick(mixed + "-_", 40)]
    planted = []
    for n, t in enumerate(texts):
        w = t.split(" ")
        at = rng.randrange(len(w) + 1)
        secret = makers[n % len(makers)]()
        lead = rng.choice(["", "key ", "Authorization: Bearer ", "use "])
        start = len(" ".join([*w[:at], lead])) if at else len(lead)
        whole = " ".join([*w[:at], lead + secret, *w[at:]])
        start = whole.index(secret)
        if secrets.candidates(whole, secrets.base_spans(whole)).count((start, start + len(secret))):
            planted.append((whole, start, start + len(secret)))
    network = secrets.train(docs)
    found = [any(k == "model" and a < e and s < b for k, a, b in spans) for (_, s, e), (_, spans, _) in zip(planted, secrets.scan(network, pa.array([t for t, _, _ in planted], pa.large_string())), strict=True)]
    assert len(planted) > 150 and sum(found) >= 0.9 * len(found)
    clean = secrets.scan(network, pa.array(texts, pa.large_string()))
    assert sum(any(k == "model" for k, _, _ in spans) for _, spans, _ in clean) <= 0.02 * len(texts)
    based = secrets.scan(network, pa.array([f"api_key = '{pick(mixed, 32)}' and AKIA{pick('ABCDEFGH23456789', 16)}" for _ in range(50)], pa.large_string()))
    assert all(len(b) == 2 and b == spans for b, spans, _ in based) and sum(n for _, _, n in based) >= 90  # scored, and kept in any case


def test_candidates_in_a_long_dump():
    text = "token = abcdef1234567890 zz0123456789012345zz " * 4000
    base = secrets.base_spans(text)
    plain = [m.span() for m in secrets.CANDIDATE.finditer(text[:4000]) if not any(s < m.end() and m.start() < e for _, s, e in base[:100])]
    assert secrets.candidates(text, base)[: len(plain) - 1] == plain[:-1] and len(secrets.candidates(text, base)) == 4000


def test_threshold_keeps_recall(trained):
    """On rows whose truth is hard to tell, and on held-back findings outside the base patterns."""
    rows = secrets.labelled_findings(720)
    x, y = np.stack([secrets.encode(*q[:3]) for q in rows]), np.array([q[3] for q in rows], float)
    y[np.random.default_rng(2).random(len(y)) < 0.4] = 0  # as where true findings are labelled 0
    y[np.random.default_rng(3).random(len(y)) < 0.1] = 1
    network = secrets.fit_network(x, y, epochs=2)
    held = (np.arange(len(x)) % 4 == 3) & (y == 1)
    accepted = network.probability(x[held]) >= network.threshold
    assert accepted.mean() >= secrets.RECALL
    found = secrets.recall_findings()
    seen = {q[0] for q in [*secrets.labelled_findings(), *secrets.glued_findings()]}
    assert len(found) > 500 and not any(t in seen or any(a < e and s < b for _, a, b in secrets.base_spans(t)) for t, s, e in found)
    assert (secrets.best(trained, found) >= trained.threshold).mean() >= secrets.RECALL
    fresh = secrets.recall_findings(91)
    assert (secrets.best(trained, fresh) >= trained.threshold).mean() >= secrets.RECALL - 0.02
