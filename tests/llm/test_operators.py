"""Every operator against a plain version of its contract, on awkward rows and on none."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from phaseline.llm import bpe, linededup, lm, media, mixing, neardup, quality, secrets, suffixes, tokenfile

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def by_row(df):
    """Rows as (doc_id, rest) multisets."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- op1


def test_secrets_base_and_method(docs, rows, empty):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for i, x, _, _ in rows:
        x = x or ""
        f = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[2]) >= 6]
        f += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
        f += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        s = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(f))
        want.append((i, *(sum(k == j for _, k, _ in f) for j in range(3)), hashlib.sha256(s.encode()).hexdigest()))
    got = secrets.digest(secrets.scan(docs))
    assert by_row(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) == sorted(want, key=repr)
    assert secrets.digest(secrets.scan(empty)).count() == 0


def test_secret_constants_reach_sensitive_names():
    text = 'a = "Zx9!kkPqL02mmQ"\nb = a\nmax_len = "Zx9!kkPqL02mmR"\ndb_password = b\n'
    kinds = {(k, text[s:e]) for k, s, e, _, _ in secrets.scan_text(text)}
    assert kinds == {("constant", "Zx9!kkPqL02mmQ")}
    text = '{"client_secret": "q8Jd82!kdLwp0", "color": "q8Jd82!kdLwp1", signing_key := \'pp0Kd82!kdLwX\'}'
    assert {text[s:e] for k, s, e, _, _ in secrets.scan_text(text) if k == "literal"} == {"q8Jd82!kdLwp0", "pp0Kd82!kdLwX"}
    assert secrets.scan_text("tokens ſecret = abcdefgh") == []  # letters of ASCII only


def test_names_of_light_words_need_no_other_word():
    """A pair's verdict doesn't depend on words elsewhere in the text."""
    for name in ("api_access", "private_access", "signingAccess"):
        pair = f'{name} = "Zq8$Lm2#Xv9!Tb4@"'
        alone, beside = secrets.scan_text(pair), secrets.scan_text(f"{pair}\nthe author")
        assert [f[0] for f in alone] == ["literal"] and alone == beside


def test_long_literals_are_judged_whole():
    """Padding at both ends of a long literal doesn't hide its middle."""
    middle = hashlib.sha512(b"x").hexdigest().upper() * 40
    found = secrets.scan_text(f'cred = "{"xy" * 1100}{middle}{"xy" * 1100}"')
    assert [f[0] for f in found] == ["literal"]


def test_syntax_of_literals():
    """Elements of markup, three quotes and joins over lines are read; a value that only looks like one is not."""
    found = lambda x: {x[a:b] for k, a, b, *_ in secrets.scan_text(x) if k in ("literal", "constant")}
    assert found("<conf><dbPassword id='1'> q8Jd82!kdLwp0 </dbPassword><color>q8Jd82!kdLwp1</color></conf>") == {"q8Jd82!kdLwp0"}
    assert found('client_secret = """q8Jd82!\nkdLwp0 x"""\ncolor = 1') == {"q8Jd82!\nkdLwp0 x"}
    assert found('auth_token = "q8Jd82!kdL" +\n    "wp0Zz91?kkP"') == {"q8Jd82!kdL", "wp0Zz91?kkP"}
    assert found("<tokenCount>q8Jd82!kdLwp0</tokenCount>") == set()


SECRET = "Xk9$Qw7!Lp2mVn4r"


@pytest.mark.parametrize(
    "form",
    [
        'db_password: str = "{}"', 'const dbPassword string = "{}"', 'const apiKey: string = "{}"', 'private static final String API_SECRET = "{}";', "export DB_PASSWORD={}",
        '<add key="DbPassword" value="{}"/>', '<db password="{}">', '<param name="db_password">{}</param>', "- name: DB_PASSWORD\n  value: {}\n", '{{"name": "DB_PASSWORD", "value": "{}"}}',
        'db_password:\n    "{}"', 'db_password = (\n    "{}"\n)', "client_secret: |\n  {}\nother: 1", 'define("DB_PASSWORD", "{}");', 'cfg.get("pw", "{}")', 'passwords = ["{}", "y"]',
        'db_password, x = "{}", 1', 'x, db_password = 1, "{}"', 'a = b = "{}"\ndb_password = a', 'a = b = "{}"\ndb_password = b', "DB_PASSWORD ?= {}", 'db_password <- "{}"', 'db_password += "{}"',
        'connect(user="x", password="{}")', "[db]\npassword = {}\n", 'if x:\n  a = "{}"\ndb_password = a',
    ],
)
def test_syntax_of_assignments(form):
    text = form.format(SECRET)
    assert SECRET in {text[a:b] for k, a, b, *_ in secrets.scan_text(text) if k in ("literal", "constant")}
    color = form.format(SECRET).replace("assword", "ainting").replace("ASSWORD", "AINTING").replace("pw", "px").replace("apiKey", "apple").replace("API_SECRET", "APPLE").replace("client_secret", "client_color")
    assert not [f for f in secrets.scan_text(color) if f[0] in ("literal", "constant")]


def test_neighbouring_quotes_scopes_and_escapes():
    found = lambda x: {(k, x[a:b]) for k, a, b, *_ in secrets.scan_text(x) if k in ("literal", "constant")}
    assert found('db_password = ("Xk9$Qw7!" "Lp2mVn4r")') == {("literal", "Xk9$Qw7!"), ("literal", "Lp2mVn4r")}
    outer = 'k = "Zx9!kkPqL02mmQ"\ndef f():\n    k = "Zx9!kkPqL02mmR"\n    return 1\n'
    assert found(f"{outer}db_password = k") == {("constant", "Zx9!kkPqL02mmQ")}
    assert found(outer + "def g():\n    db_password = k") == {("constant", "Zx9!kkPqL02mmQ")}
    assert found('{k: "Zx9!kkPqL02mmQ", sub: {k: "Zx9!kkPqL02mmR"}, db_password: k}') == {("constant", "Zx9!kkPqL02mmQ")}
    assert secrets.decoded(r"\x41\u00e9\u{1F642}\n\\\q") == "A\u00e9\U0001f642\n\\q"
    plain = r"\x61" * 12  # one letter, twelve times: no secret once it is decoded
    assert found(f'db_password = "{plain}"') == set()


@pytest.mark.parametrize("piece", ["password = [", "password = (", 'password = "', '<a key="x" ', "key, ", "a = ", "{k: ", 'x = ("a" "b" ', "password = a + b ", "key : a", " key\n  key: |\n", "w "])
def test_lexing_takes_linear_time(piece):
    """Ten times the text takes about ten times the steps, counted as calls of Python functions."""
    import sys

    def steps(n):
        count = 0

        def tick(frame, event, arg):
            nonlocal count
            count += 1

        sys.setprofile(tick)
        try:
            secrets.scan_text(piece * n + ' token = "Zx9!kkPqL02mmQ"')
        finally:
            sys.setprofile(None)
        return count

    assert steps(4_000) < 14 * steps(400) + 2_000


def test_secrets_of_long_texts():
    """Lexing takes time in proportion to a text, also where constants are joined upon constants."""
    import time

    def seconds(n):
        text = 'master = "Zx9!kkPqL02mmQ"\n' + 's = s + "Zx9!kkPqL02mmR"\nsecret_key = secret_key + s\n' * n
        begin = time.process_time()
        found = secrets.scan_text(text)
        return time.process_time() - begin, len(found)

    seconds(100)
    (one, few), (eight, many) = seconds(5_000), seconds(40_000)
    assert eight < 16 * max(one, 0.05) and many > 7 * few
    text = "w " * 3_000_000 + 'db_password = "Zx9!kkPqL02mmQ"'
    assert [f[0] for f in secrets.scan_text(text)] == ["literal"]


# ---------------------------------------------------------------- op2


def test_media_round_trip(docs, rows, empty):
    want = []
    for i, x, _, _ in rows:
        b = (x or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = media.digest(media.media_table(docs))
    assert by_row(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) == sorted(want, key=repr)
    features = defaultdict(set)
    texts = {(i, x or "") for i, x, _, _ in rows}
    for r in got.collect():
        features[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in features.values()) and len(features) <= len({x for _, x in texts})
    assert media.digest(media.media_table(empty)).count() == 0


@pytest.mark.parametrize("up,down", [(1, 2), (3, 2), (2, 3), (1, 1)])
def test_polyphase_equals_direct_filtering(up, down):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 301):
        x = rng.normal(size=n).astype(np.float32)
        h = media.low_pass(up, down)
        z = np.zeros(n * up)
        z[::up] = x
        want = np.concatenate([np.convolve(z, h)[len(h) // 2 :], np.zeros(9)])[::down][: -(-n * up // down)]
        assert np.allclose(media.resample(x, up, down), want, atol=1e-4)


def test_tensors_and_segments():
    t = np.arange(16_000)
    tone = np.where((t > 4000) & (t < 9000), 100 * np.sin(t / 3), 0) + 128
    frames, stream, spans = media.features(media.write_wav(tone.astype(np.uint8).tobytes()))
    tensors, times = media.read_tensors(stream)
    assert tensors.shape[1:] == (media.TENSOR, media.MELS) and len(times) == len(tensors) == -(-frames // media.TENSOR)
    assert len(spans) == 1 and abs(spans[0][0] - 250) < 30 and abs(spans[0][1] - 562) < 30


# ---------------------------------------------------------------- op3, op9


def test_bpe_equals_library(docs, rows, empty):
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.encode(docs, ranks, P.PATTERN)
    assert by_row(ids) == sorted(((i, enc.encode_ordinary(x or "")) for i, x, _, _ in rows), key=repr)
    back = bpe.decode(ids, ranks)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((i, (x or "").encode()) for i, x, _, _ in rows)
    assert bpe.digests(empty, ranks, P.PATTERN).count() == 0
    assert bpe.decode(ids.selectExpr("doc_id", "cast(null as array<int>) ids").limit(1), ranks).first().decoded is None


def test_token_file(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        js = f.read()
    t = Tokenizer.from_str(js)
    ordered = sorted(((i, x or "") for i, x, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, want = 0, []
    for i, x in ordered:
        ids = t.encode(x, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert by_row(tokenfile.checksums(docs, f"{tmp_path}/a", js, 2)) == sorted(want, key=repr)
    assert tokenfile.checksums(empty, f"{tmp_path}/b", js, 2).count() == 0
    r = tokenfile.read(spark, f"{tmp_path}/a").where("key = 83").first()
    assert r.ids == t.encode("one two", add_special_tokens=False).ids + [2]


def test_codes_are_short_and_decode():
    rng = np.random.default_rng(0)
    counts = rng.geometric(0.001, 3000) ** 2
    for most in (12, 14, 25):
        n = tokenfile.code_lengths(counts, most)
        assert n.max() <= most and abs(sum(2.0 ** -n) - 1) < 1e-12
    ids = rng.choice(3000, 5000, p=counts / counts.sum())
    for size in (0, 1, 127, 128, 129, 5000):
        data, at = tokenfile.pack_bits(ids[:size], tokenfile.canonical(n), n)
        assert (tokenfile.unpack_bits(data, at, size, tokenfile.decode_table(n)) == ids[:size]).all()
    # optimal against a plain Huffman tree where the limit does not bind
    import heapq

    counts = rng.integers(1, 1000, 500)
    n = tokenfile.code_lengths(counts, 25)
    h = [int(c) for c in counts]
    heapq.heapify(h)
    total = 0
    while len(h) > 1:
        s = heapq.heappop(h) + heapq.heappop(h)
        total += s
        heapq.heappush(h, s)
    assert total == int((counts * n).sum())


def test_pieces_equal_whole_texts():
    import random

    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        js = f.read()
    t, pieces, rng = Tokenizer.from_str(js), tokenfile.Pieces(js), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "　", "\xa0", "é", "1", "²", "￿", "<|endoftext|>", "'s", " x", "!", "\x85", "中", "\x1c", "\r\n", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", "￿", " "]
    for g in range(0, len(texts), 100):
        own = texts[g : g + 100]
        listed, flat, per = tokenfile.number_pieces(own)
        (start, size, every), at = pieces.encode(listed), 0
        for x, n in zip(own, per):
            ids = [i for k in flat[at : at + n] for i in every[start[k] :][: size[k]].tolist()]
            at += n
            assert ids == t.encode(x, add_special_tokens=False).ids


def test_added_tokens_are_the_librarys(spark, tmp_path):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        js = f.read()
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    tokenfile.write(df, f"{tmp_path}/a", js, 2)
    assert tokenfile.read(spark, f"{tmp_path}/a").first().ids == [64, 220, 50256, 275, 2]


# ---------------------------------------------------------------- op4


def shingles(text):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def linked(items):
    """Smallest key reachable of every key; rows of a key are one document."""
    keys = sorted({i for i, _ in items if i is not None})
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, s) in enumerate(items):
        for j, t in items[:n]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {k: find(k) for k in keys}


def near_want(rows):
    items = [(i, shingles(x)) for i, x, *_ in rows]
    c = linked(items)
    return sorted(((i, len(s), c.get(i), i is None or c[i] == i) for i, s in items), key=repr)


@pytest.mark.parametrize("most", [2048, 4])
def test_near_duplicates(docs, rows, empty, most):
    assert by_row(neardup.near_duplicates(docs, most_members=most)) == near_want(rows)
    assert neardup.near_duplicates(empty).count() == 0


def test_large_star_in_slices(spark):
    """Many variants of one text, in regions that must be taken deeper and sliced."""
    import random

    rng = random.Random(1)
    base = [f"t{k}" for k in range(80)]
    made = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        w[rng.randrange(5, 75)] = f"z{i}"
        made.append((i, " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = neardup.near_duplicates(df, most_members=16)
    assert by_row(got) == near_want(made)


def test_large_region_without_a_hub(spark):
    """Pairs of 0.79 among texts that are otherwise 0.69 alike: no member links to a hub, and regions must be parted."""
    core = [f"t{k}" for k in range(140)]
    made = [(i, " ".join(core + [f"p{i // 2}x{k}" for k in range(12)] + [f"o{i}x{k}" for k in range(20)])) for i in range(160)]
    assert all(r[2] == r[0] - r[0] % 2 for r in near_want(made))
    df = spark.createDataFrame(made, "doc_id long, text string")
    for most in (8, 32):
        assert by_row(neardup.near_duplicates(df, most_members=most)) == near_want(made)


@pytest.mark.parametrize("most,rare", [(1024, 32), (4, 3)])
def test_rare_shingles_meet_every_link(spark, monkeypatch, most, rare):
    """Members that share a template in part: every two that are alike enough are in some task, whatever their sizes; many others are not."""
    import random

    monkeypatch.setattr(neardup, "RARE", rare)
    rng, made = random.Random(3), []
    templates = [[f"t{j}x{k}" for k in range(60)] for j in range(3)]
    for i in range(140):
        w = list(templates[i % 3]) + [f"o{i}x{k}" for k in range(rng.randrange(1, 16))]
        for _ in range(rng.randrange(2)):
            w[rng.randrange(60)] = f"c{i // 4}"
        made.append((i, " ".join(w[rng.randrange(6) :])))
    sets = {i: shingles(x) for i, x in made}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    members = spark.createDataFrame([(i, i) for i in sets], "key long, component long")
    texts = spark.createDataFrame([*made, made[5]], "key long, x string")
    tasks = defaultdict(set)
    for r in neardup._rare_tasks(members, texts, 5, 75, most, 1 << 30).collect():
        tasks[r.task].add(r.key)
    met = {(a, b) for t in tasks.values() for a in t for b in t if a < b}
    assert len(links) > 50 and links <= met
    assert max(map(len, tasks.values())) <= most if most > 8 else True


# ---------------------------------------------------------------- op5


def line_want(rows, percent, least):
    """Kept text of each row, by position."""
    hosts, seen = Counter(), Counter()
    key = lambda v: v.strip(" \t\r")
    for _, x, h in rows:
        hosts[h] += 1
        seen.update({(h, key(v)) for v in (x or "").split("\n") if key(v)})
    gone = {k for k, n in seen.items() if n >= least and 100 * n > percent * hosts[k[0]]}
    return sorted(((i, None if x is None else "\n".join(v for v in x.split("\n") if (h, key(v)) not in gone)) for i, x, h in rows), key=repr)


def test_line_dedup(docs, rows, empty):
    want = line_want([(i, x, s) for i, x, _, s in rows], 10, 3)
    got = linededup.drop_boilerplate(docs, "text", "source", 10, 3)
    assert got.columns == docs.columns
    assert by_row(got.select("doc_id", "text")) == want
    assert {tuple(r) for r in got.select("_kept", "x", "key").collect()} == {("clash",) * 3}
    assert sum("boiler plate line" in (t or "") for _, t in want) == 0
    assert linededup.drop_boilerplate(empty, "text", "source").count() == 0


def test_page_lines(spark):
    html = "<html><body><P class='a'>One</p><script>var a='<p>';</script><!-- x --><div>Two <b>bold</b></div><br/>Three</body></html>"
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", html if k else None) for k in range(5)], "page_id long, url string, html string")
    got = {r.page_id: r for r in linededup.clean_pages(pages).collect()}
    assert got[0].text is None and got[0].n_lines == 0 and got[1].host == "h.example"
    assert got[1].n_lines == 3 and got[1].n_dropped == 3 and got[1].text.strip() == ""


# ---------------------------------------------------------------- op6


def test_mixing(docs, rows, empty):
    sizes = Counter()
    for i, x, _, s in rows:
        sizes[s] += len(words(x))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    named = mixing.mix(docs.select("doc_id", "source", mixing.word_count(docs.text).alias("w")), "source", "w", "doc_id").collect()
    got = mixing.mixture(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, len(words(x))) for i, x, _, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken = Counter()
    for r in named:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in order)
    assert by_row(mixing.mixture(docs)) == by_row(mixing.mixture(docs.repartition(7)))
    assert mixing.mixture(empty).count() == 0 and mixing.apply_mixture(empty).count() == 0
    mixed = mixing.apply_mixture(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.select("size" if "size" in docs.columns else "n", "taken", "target").collect()} == {("clash",) * 3}


# ---------------------------------------------------------------- op7


def base_counts(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [v for v in x.split("\n") if v.strip(BLANKS)]
    return len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, rows, empty):
    got = quality.rules(docs)
    want = []
    for i, x, _, _ in rows:
        c = base_counts(x)
        want.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert by_row(got.drop("kept")) == sorted(want, key=repr)
    for r in got.collect():
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and r.doc_id < 30:
            assert r.kept
    assert not {r.doc_id: r.kept for r in got.collect()}[93]
    assert quality.rules(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_quality_sql(spark, docs, rows):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    documents = pd.DataFrame([r for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    c.register("documents", documents)
    a = c.sql(quality.rules_sql()).fetchall()
    b = quality.rules(docs).collect()
    assert sorted(map(repr, map(tuple, a))) == sorted(map(repr, map(tuple, b)))


# ---------------------------------------------------------------- op8


def repeats_want(texts, n, words=50):
    count = Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    copies, holders = Counter(texts), defaultdict(set)
    for t in copies:
        w = t.split()
        for k in range(len(w) - words + 1):
            holders[tuple(w[k : k + words])].add(t)
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        w = t.split()
        passage = {k + j for k in range(len(w) - words + 1) if copies[t] > 1 or len(holders[tuple(w[k : k + words])]) > 1 for j in range(words)}
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest(), len(passage)))
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix_dedup(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    small = [(i, x) for i, x, _, _ in rows if x is None or len(x) < 20_000]
    d = docs.where("text is null or length(text) < 20000")
    want = [(i, *w) for (i, _), w in zip(small, repeats_want([(x or "").encode() for _, x in small], 400))]
    assert by_row(suffixes.remove_repeats(d)) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 3000
    assert suffixes.remove_repeats(empty).count() == 0
    long = suffixes.remove_repeats(docs.where("doc_id in (87, 88)")).collect()  # one text that repeats itself throughout
    assert all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in long)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_chunks(docs, rows, monkeypatch, hot):
    """Blocks, chunks and buckets far smaller than a text give the same, and so do hot anchors."""
    for name, v in (("BLOCK_BYTES", 4000), ("CHUNK_BYTES", 700), ("BUCKET_BYTES", 2000), ("HOT", hot), ("SPLITTERS", 16), ("RUN_BYTES", 1000)):
        monkeypatch.setattr(suffixes, name, v)
    small = [(i, x) for i, x, _, _ in rows if x and 60 <= (i or 0) < 80]
    d = docs.where("doc_id between 60 and 79")
    want = [(i, *w) for (i, _), w in zip(small, repeats_want([x.encode() for _, x in small], 60, 12))]
    assert by_row(suffixes.remove_repeats(d, length=60, words=12)) == sorted(want, key=repr)


@pytest.mark.parametrize("at", [0, 384, 192])
def test_strings_that_differ_in_one_place_stay(spark, at):
    """Texts of one template that differ in 16 bytes repeat nothing of 400 bytes."""
    template = "".join(f"{k:03d}." for k in range(100))
    made = [(i, template[:at] + f"{i * 7919:016d}" + template[at + 16 :]) for i in range(20_000)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = suffixes.remove_repeats(df, words=500)
    assert got.where("n_removed > 0 or n_bytes <> 400").count() == 0


def test_equal_fingerprints_are_told_apart_by_bytes(monkeypatch):
    """With fingerprints of one bit the bytes still decide."""
    rng = np.random.default_rng(2)
    t = bytes(rng.integers(97, 99, 4000, dtype=np.uint8))
    p, n = np.arange(len(t) - 9), 10
    count = Counter(t[i : i + n] for i in p.tolist())
    monkeypatch.setattr(suffixes.Rolling, "at", lambda self, p, size: np.zeros(len(p), np.uint64) + np.uint64(0) * p.astype(np.uint64))
    hit = suffixes.confirmed(t, p, np.full(len(p), n), np.arange(len(p)), np.zeros(len(p), bool))
    assert hit.tolist() == [count[t[i : i + n]] > 1 for i in p.tolist()]


def test_passages_of_words(spark):
    """A passage counts where another text has it, however it is spaced, and not where one text repeats it."""
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    passage = " ".join(f"p{k}" for k in range(51))
    made = [(0, f"{own(0, 30)} {passage} {own(10, 30)}"), (1, f"{own(1, 9)}\n" + passage.replace(" ", "  ") + f"\t{own(11, 50)}"), (2, f"{own(2, 70)}"), (3, f"{own(3, 60)}\n" * 2), (4, passage[: passage.index(" p49")])]
    got = suffixes.remove_repeats(spark.createDataFrame(made, "doc_id long, text string"))
    assert {r.doc_id: r.n_passage_words for r in got.collect()} == {0: 51, 1: 51, 2: 0, 3: 0, 4: 0}


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    for high in (2, 50, 2**32 - 1):
        t = rng.integers(0, high, (3, 5000), dtype=np.uint32)
        o = suffixes.multikey_quicksort(t)
        assert (t[:, o] == t[:, np.lexsort(t[::-1])]).all()


# ---------------------------------------------------------------- op10


@pytest.mark.parametrize("block_bytes", [8 << 20, 3000])
def test_lm(docs, rows, empty, monkeypatch, block_bytes):
    """Scores against a plain recursion over counts, in one block and in many."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", block_bytes)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    texts = [(i, (x or "").encode().lower().split() + [None]) for i, x, _, _ in rows]
    one, two, three, of = Counter(), Counter(), Counter(), Counter()
    for i, w in texts:
        if not held(i):
            one.update(w)
            of.update(["^"] + w[:-1])
            two.update(zip(["^"] + w[:-1], w))
            three.update(zip(["^"] + w[:-2], w[:-1], w[1:]))
    n, v, q = sum(one.values()), len(one), lm.WEIGHT
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda h, w: q * two[h, w] / of[h] + (1 - q) * p(w) if two[h, w] else (1 - q) * p(w) if of[h] else p(w)
    p3 = lambda g, h, w: (q * three[g, h, w] / two[g, h] + (1 - q) * p2(h, w)) if two[g, h] >= lm.LEAST_STATE else p2(h, w)
    want = []
    for i, w in texts:
        full = math.log10(p2("^", w[0])) + sum(math.log10(p3(g, h, x)) for g, h, x in zip(["^"] + w[:-2], w[:-1], w[1:]))
        want.append((i, held(i), len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), full))
    assert sum(c >= lm.LEAST_STATE for c in two.values()) > 100
    got = [tuple(r) for r in lm.score(docs).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(b[5]) and abs(a[6] - b[6]) < 1e-6 * abs(b[6])
    assert lm.score(empty).count() == 0
    only = lm.score(docs.where("doc_id = 2").limit(1)).first()
    assert only.train_tokens == only.n_tokens


def _automaton(texts):
    """The automaton of one block that holds all there is."""
    t = lm.tokenised(list(range(1, len(texts) + 1)), texts)
    b = lm.Block(t["docs"], t["times"], t["tokens"])
    b.learn_words(b.times, np.arange(b.width, dtype=np.uint64), np.zeros(b.width, bool))
    b.asked_pairs(1)
    b.learn_pairs(np.zeros(0, np.int64), np.zeros(0, bool))
    b.learn_triples(np.zeros(0, np.int64))
    real = np.arange(b.width) != b.start
    return b, lm.Automaton(b, int(b.times[real].sum()), int((b.times[real] > 0).sum()), lm.WEIGHT)


def test_arcs_of_each_state_sum_to_one():
    """Of every state built: its arcs, and what its failure arc leaves to the words it has none for."""
    rng = np.random.default_rng(3)
    b, a = _automaton([" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 30), p=np.arange(8, 0, -1) / 36)).encode() for _ in range(200)])
    arcs = defaultdict(dict)
    for s, w, x, _ in a.arcs():
        assert w not in arcs[s]
        arcs[s][w] = 10**x
    n, v = int(b.times.sum() - b.times[b.start]), int((b.times > 0).sum() - 1)
    unknown = lm.ADD / (n + lm.ADD * (v + 1))
    vocabulary = [w for w in range(b.width) if w != b.start and b.times[w] > 0]

    def read(s, w):
        return arcs[s][w] if w in arcs[s] else 10 ** a.fail_weight[s] * read(a.fail[s], w) if s else unknown

    assert sum(s > b.width for s in arcs) > 20
    for s in arcs:
        assert abs(sum(read(s, w) for w in vocabulary) + read(s, -1) - 1) < 1e-9


@pytest.mark.parametrize("steps", [1 << 16, 7, 1])
def test_traversal_walks_the_states(monkeypatch, steps):
    """The scores of a walk over a table of arcs; the state goes on from slice to slice of any length."""
    monkeypatch.setattr(lm, "STEPS", steps)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefghijkl"), rng.integers(0, 40))).encode() for _ in range(120)]
    b, a = _automaton(texts)
    arcs = {(s, w): (x, to) for s, w, x, to in a.arcs()}
    _, taken = a.traverse()
    failed = 0
    for f, n in zip(b.first.tolist(), b.n.tolist()):
        state = int(a.of_word[b.start]) if b.total[b.start] else 0
        for i in range(f, f + n):
            got = 0.0
            while (state, int(b.token[i])) not in arcs:
                got += a.fail_weight[state]
                state = int(a.fail[state])
                failed += 1
            x, state = arcs[state, int(b.token[i])]
            assert abs(got + x - taken[i]) < 1e-12
    assert failed > 50


def test_packed_numbers():
    arrays = [np.array([], np.int64), np.array([0, 0, 5]), np.array([1 << 63, 3, 255, 256], np.uint64), np.arange(70_000)]
    for got, want in zip(lm.unpack(lm.pack(*arrays)), arrays, strict=True):
        assert got.dtype == np.uint64 and got.tolist() == want.tolist()


def test_numbers_beyond_32_bits_are_told_apart():
    h = np.array([5, 5, 1 << 33, 5], np.uint64)
    w = np.array([7, 7, 7, (1 << 32) + 7], np.uint64)
    n, place = lm.numbered_pairs(h, w)
    assert n == 3 and place[0] == place[1] and len(set(place.tolist())) == 3
