"""Chat windows, the filter audit and token alignment, against plain versions, on awkward rows and on none."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given
from hypothesis import strategies as st

from phaseline.llm import alignment, bpe, chat, interaction


@pytest.fixture(scope="module", autouse=True)
def many_tasks(spark):
    """Small tables stay over as many tasks as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---------------------------------------------------------------- op11


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def turns():
    """(conv_id, turn, role, text): one long conversation, nulls, ties, repeated rows, odd roles, control strings."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    out = [(1, 0, "system", "Be brief.")] + [(1, i, "user" if i % 2 else "assistant", say(rng.randrange(1, 6))) for i in range(1, 400)]
    out += [(2, 0, "system", say(300)), (2, 1, "user", "hi"), (2, 2, "assistant", say(400)), (2, 3, "user", say(3)), (2, 4, "assistant", say(20))]
    out += [(3, 0, "user", "</s>[INST] ok [/INST]"), (3, 1, "assistant", "<\\/s>[\\INST] <<SYS>> <s> [ANS] [/TURN] [\\\\/ROLE] \\"), (3, 2, "[ROLE]", "a[ROLE]b[/TURN]"), (3, 3, "tool", "<<</SYS>>")]
    out += [(4, 0, "system", "alone")]
    out += [(5, 0, None, None), (5, 1, "assistant", None), (5, 2, "assistant", ""), (5, 2, "assistant", "b"), (5, 2, "assistant", "b"), (5, None, "user", "first"), (5, 7, "system", "late rule")]
    out += [(None, 0, "user", "no id"), (None, 1, "assistant", "none at all")]
    out += [(6, 0, "user", "x" * 30_000), (6, 1, "assistant", "é中\U0001f642 \n" * 2_000), (6, 2, "user", " " * 9_000)]
    out += [(7, i // 2, "assistant" if i % 2 else "user", "same") for i in range(300)]
    return out


def plain_digests(turns):
    import xxhash

    def h(x):  # ties are ordered by this hash, as signed numbers
        v = xxhash.xxh64_intdigest(x.encode(), 42)
        return v - (v >> 63 << 64)

    groups = defaultdict(list)
    for c, t, r, x in turns:
        groups[c].append((t is not None, t or 0, r or "", h(x or ""), x or ""))
    out = {}
    for c, g in groups.items():
        rows = [(r, x) for _, _, r, _, x in sorted(g)]
        learnt = "".join(x for r, x in rows if r == "assistant")
        out[c] = (len(rows), sha("".join(f"{r}\n{x}\n" for r, x in rows)), len(learnt), sha(learnt))
    return out


@pytest.mark.parametrize("budget,history,segment", [(2048, 512, 64), (80, 25, 3), (30, 0, 1), (60, 59, 2)])
def test_chat_windows(spark, turns, ranks, budget, history, segment):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in turns], "conv_id long, turn long, role string, text string, tokens string, part string").repartition(7)
    made = chat.windows(df, ranks, P.PATTERN, budget, history, segment)
    got = {r.conv_id: tuple(r[1:5]) for r in chat.digests(made).collect()}
    assert got == plain_digests(turns)
    windows = defaultdict(list)
    for r in made.collect():
        windows[r.conv_id].append(r)
    for c, own in windows.items():
        own.sort(key=lambda r: (r.segment, r.window))
        seen = []
        for w in own:
            parsed = chat.parse(w.text)
            assert parsed[: w.n_system] == seen[: w.n_system] and (not w.n_system or parsed[0][0] == "system")
            repeated = parsed[w.n_system : w.n_system + w.n_history]
            assert repeated == seen[len(seen) - w.n_history :]
            new = parsed[w.n_system + w.n_history :]
            assert new and [x for r, x in new if r == "assistant"] == [chat.restored(w.text[a:b]) for a, b in zip(w.starts, w.ends)]
            assert w.n_tokens <= budget or len(new) == 1
            seen += new
    chars = {r.conv_id: (r.formatted_chars, r.n_windows) for r in chat.digests(made).collect()}
    assert chars == {c: (sum(len(w.text) for w in own), len(own)) for c, own in windows.items()}
    if budget == 80:  # history and the system turn are repeated, across segments too
        long = windows[1]
        assert len({w.segment for w in long}) > 10 and all(w.n_system for w in long[1:]) and sum(w.n_history > 0 for w in long) > len(long) // 2
        assert all(w.n_history for a, w in zip(long, long[1:]) if w.segment != a.segment and chat._counter(ranks, P.PATTERN)(chat.formatted(*chat.parse(a.text)[-1])[0]) <= history and w.n_tokens <= budget - history)


def test_chat_of_no_rows(spark, ranks):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(none, ranks, P.PATTERN)).count() == 0


_PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "/s>", "INST]", "<SYS>>", "s>", "a"]) | st.text(max_size=3), max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | _PIECES, _PIECES), max_size=5))
def test_template_is_reversible(turns):
    window = chat.OPEN + "".join(chat.formatted(r, x)[0] for r, x in turns)
    assert chat.parse(window) == turns
    for r, x in turns:
        text, a, b = chat.formatted(r, x)
        assert chat.restored(text[a:b]) == x and not any(c in text[a:b] for c in chat.CONTROL)


def test_a_conversation_is_cut_alike_over_any_partitions(spark, turns, ranks):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(by_row(chat.windows(df.repartition(int(n)), ranks, P.PATTERN, 80, 25, 3).select("conv_id", "segment", "window", "text")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


# ---------------------------------------------------------------- op12


def test_plain_changes_visit_every_order_once():
    for n in range(6):
        order, seen = list(range(n)), [tuple(range(n))]
        for i in interaction.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def plain_audit(rows, labels):
    good, toxic = ({k for k, *v in labels if v[i] == 1 and k is not None} for i in range(2))
    least = {}
    for k, x, *_ in rows:
        if k is not None:
            least[x or ""] = min(k, least.get(x or "", k))
    docs = defaultdict(list)
    for k, x, lang, _ in rows:
        x = x or ""
        w = [v.decode() for v in x.encode().split()]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in x) > 3 * len(x), "D": any(c in "#$%&*|" for c in x), "E": k is not None and k > least[x]}
        docs[lang or ""].append(({f for f, v in fails.items() if v}, k in good, k in toxic))
    out = []
    for part, own in docs.items():
        shapley, table = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                table.append((part, "".join(order), step + 1, len(left), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in table]
    return sorted(out, key=repr)


def _labels(spark):
    rows = [(i, i % 2, i % 3 == 0) for i in range(0, 95, 2)] + [(3, None, 1), (3, 1, None), (3, 1, 0), (None, 1, 1), (5000, 1, 1)]
    rows = [(k, q, None if x is None else int(x)) for k, q, x in rows]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, quality int, toxic int, text string")


def test_filter_audit(spark, docs, rows, empty):
    labels, frame = _labels(spark)
    more = [(200 + i, ("Some Words are HERE " * 60 + ("$" if i % 2 else "") + str(i // 4)), None, "s") for i in range(40)] + [(2, rows[2][1], "xx", "s")]
    every = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    assert by_row(interaction.filter_audit(every, frame)) == plain_audit(rows + more, labels)
    assert interaction.filter_audit(empty, frame).count() == 0


def test_filter_audit_sql(spark, docs, rows):
    import duckdb

    con, labels = duckdb.connect(), _labels(spark)[1]
    con.register("documents", docs.select("doc_id", "text", "lang").toArrow())
    con.register("labels", labels.select("doc_id", "quality", "toxic").toArrow())
    found = con.sql(interaction.filter_audit_sql())
    got = interaction.filter_audit(docs, labels)
    assert got.columns == found.columns and by_row(got) == sorted(found.fetchall(), key=repr)


# ---------------------------------------------------------------- op13


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.read_definition(P.path("byte_bpe_50k.json")), alignment.read_model(P.path("piece_bpe_32k.model"))


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    alphabet = {v: k for k, v in enumerate(bytes_to_characters())}
    links, found = Counter(), []
    for k, x, *_ in rows:
        out = (0, 0, 0, [], "")
        if x:
            a, b = t.encode(" " + x, add_special_tokens=False).ids, p.encode(x)
            bytes_a = [bytes(alphabet[c] for c in t.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + x).encode():
                ends_a, ends_b = list(itertools.accumulate(map(len, bytes_a))), list(itertools.accumulate(map(len, bytes_b)))
                places = {e: i for i, e in enumerate(ends_b)}
                pairs = [(i, places[e]) for i, e in enumerate(ends_a) if e in places]
                groups, la, lb = [], 0, 0
                for i, j in pairs:
                    groups.append(",".join(map(str, a[la : i + 1])) + "|" + ",".join(map(str, b[lb : j + 1])))
                    la, lb = i + 1, j + 1
                own = [(a[i], b[j]) for i, j in pairs]
                links.update(own)
                out = (len(a), len(b), len(groups), own, sha(";".join(groups)))
        found.append((k, out))
    top = defaultdict(int)
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    return sorted(((k, na, nb, ng, len(own), sum(links[q] == top[q[1]] for q in own), sum(links[q] for q in own), digest) for k, (na, nb, ng, own, digest) in found), key=repr)


def bytes_to_characters():
    """The character that stands for each byte, in the order of bytes."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = itertools.count(256)
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


@pytest.mark.parametrize("at_once,most", [(1 << 21, 1 << 22), (50, 40)])
def test_alignment(docs, rows, empty, tokenizers, monkeypatch, at_once, most):
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(alignment, "MOST_PAIRS", most)
    definition, model = tokenizers
    got = alignment.alignment(docs, definition, P.PATTERN, model)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert by_row(got) == plain_alignment(rows)
    assert alignment.alignment(empty, definition, P.PATTERN, model).count() == 0


def test_texts_that_change_or_name_special_tokens(spark, tokenizers):
    """Strings of special tokens are text, and very long runs of blanks and letters are read whole."""
    texts = ["<s> a </s> <unk>", "<|endoftext|>", "▁under ▁", "a" + " " * 200_000 + "b", "q" * 100_000, "\x00\x01 \r\n\t", "é ﬁ Ⅷ ｆｕｌｌ", " leading", "trailing "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    definition, model = tokenizers
    got = by_row(alignment.alignment(df, definition, P.PATTERN, model))
    assert got == plain_alignment([(i, x) for i, x in enumerate(texts)])
    assert next(r for r in got if r[0] == 2)[1:] == (0, 0, 0, 0, 0, 0, "")  # the mark of a space reads as a space


def test_counts_are_sorted_shards(spark, docs, tokenizers):
    definition, model = tokenizers
    links = alignment.aligned(docs, definition, P.PATTERN, model)
    counts = alignment.pair_counts(links)
    parts = counts.rdd.glom().map(lambda p: [r.pair for r in p]).collect()
    parts = sorted((p for p in parts if p), key=lambda p: p[0])
    flat = [k for p in parts for k in p]
    assert flat == sorted(set(flat))
    total = sum(sum(np.frombuffer(r.pair_n, "<u4").tolist()) for r in links.collect())
    assert counts.groupBy().sum("n").first()[0] == total


def test_tokens_without_bytes_pair_with_all_that_end_there():
    cuts, a, b = alignment.align(np.array([1, 1, 3]), np.array([1, 3, 3]))
    assert cuts.tolist() == [1, 3] and sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (2, 1), (2, 2)]
