"""Merkle proofs and the repair of conversations against plain versions."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tidewatch.llm import merkle, repair

DOC = "doc_id long, text string, lang string, source string, n_chars long, rank long, tree string, digest string, path string"
TURN = "conv_id long, turn long, role string, text string, at long, fault string, kind long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_tree(nodes):
    paths, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for x in range(len(run)):
                for leaf in owners[at + x]:
                    paths[leaf].append(("".join(run[:x]), "".join(run[x + 1 :])))
            above.append(H(*run))
            over.append([leaf for x in owners[at : at + 8] for leaf in x])
        nodes, owners = above, over
    return nodes[0], paths


def plain_proofs(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    by = {}
    for i, text, lang, source, n in rows:
        leaf, tampered = (H(*map(field, (i, source, lang, n, t))) for t in (text, lower(text)))
        by.setdefault(lang, []).append((i, leaf, tampered if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else leaf))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subs = {lang: plain_tree([leaf for _, leaf, _ in by[lang]]) for lang in langs}
    root, upper = plain_tree([subs[lang][0] for lang in langs])
    out = []
    for lang, rest in zip(langs, upper):
        for (i, leaf, now), path in zip(by[lang], subs[lang][1]):
            for a, b in path + rest:
                now = H(a, now, b)
            out.append((i, leaf, subs[lang][0], root, H(*[a + b for a, b in path + rest]), now, now == root))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(*r, 9, "t", "d", "p") for r in rows], DOC)


def in_order(rows):
    return sorted(tuple(map(str, r)) for r in rows)


RNG = random.Random(4)
MANIFESTS = {
    "one leaf": [(7, "Hello", "en", "s", 5)],
    "nulls, ties and repeated rows": [(1, None, None, None, None), (2, "", "en", "x", 0), (2, "", "en", "x", 0), (2, "B", "en", "x", 0), (None, "A", "en", None, 3), (3, "é🙂A" * 9_000, "", "s", 2)],
    "four levels": [(i, f"Text {i} A", RNG.choice(["en", "en", "en", "fr", None, "é"]), "s", i) for i in range(1_100)],
    "many languages": [(i, f"T{i}", f"l{i % 75}", None, None) for i in range(200)],
}


@pytest.mark.parametrize("name", MANIFESTS)
def test_proofs_are_those_of_the_plain_tree(spark, name):
    got = merkle.proofs(documents(spark, MANIFESTS[name]))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert in_order(got.collect()) == in_order(plain_proofs(MANIFESTS[name]))


def test_no_documents_have_no_proofs(spark):
    assert merkle.proofs(documents(spark, [])).collect() == []


def test_requests_for_some_leaves_descend_alone(spark):
    rows = MANIFESTS["four levels"]
    manifest = merkle.build(documents(spark, rows))
    asked = manifest.leaves.filter("lang = 'en' AND rank % 97 = 3").select("lang", "rank", "leaf")
    got = merkle.prove(manifest, asked).select("leaf", "digest", merkle.folded(merkle.F.col("leaf")).alias("root")).collect()
    assert len(got) == asked.count() > 5
    assert all(r.leaf == r.digest and r.root == manifest.root.hex() for r in got)


def test_equal_subtrees_share_a_record(spark):
    rows = [(None, "same", "en", "s", 4)] * 64
    manifest = merkle.build(documents(spark, rows))
    assert spark.read.parquet(f"{manifest.records}/tree=leaf/height=1").count() == 1
    assert in_order(merkle.proofs(documents(spark, rows)).collect()) == in_order(plain_proofs(rows))


GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = spaced[2:]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Tries every edit at every row, from the front, with the costs of all ways from there."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults = plain_faults(rows)

    @cache
    def best(i, last, inserted):  # last: the initial before; at most two rows are inserted in one place
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]

        def edit(letter, cost, rest, row=None):
            ways.append((cost + rest[0], letter + rest[1], ((row,) if row else ()) + rest[2]))

        if inserted < 2:
            for initial, role in (("u", "user"), ("a", "assistant")):
                if initial in follow:
                    edit("I", 2, best(i, initial, inserted + 1), f"{role}:")
        if i < len(rows):
            role, text = rows[i][2:]
            edit("D", 3, best(i + 1, last, 0))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if role[:1] and role[:1] in follow:
                    edit("K", cut, best(i + 1, role[:1], 0), f"{role}:{text}")
                for new in ("user", "assistant"):
                    if new[0] in follow:
                        edit("R", 2 + cut, best(i + 1, new[0], 0), f"{new}:{text}")
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    assert GRAMMAR.fullmatch("".join(x[0] for x in out))
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, H("\n".join(out))


def plain_conversations(rows):
    left = plain_damage(rows)
    return [(conv, *plain_repair([r for r in left if r[0] == conv])) for conv in {r[0] for r in rows}]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2) for r in rows], TURN)


def random_turns(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "s", None]
    texts = ["Yes.", "No", "", " \n", "Why?\t", "é!", None, "a.b", "Yes."]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(longest)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn // 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(99)}."))
    return rows


@pytest.mark.parametrize("seed, convs, longest, piece", [(1, 60, 12, 512), (2, 40, 30, 4), (3, 25, 40, 1)])
def test_repairs_are_those_of_trying_everything(spark, monkeypatch, seed, convs, longest, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = random_turns(seed, convs, longest)
    assert in_order(repair.repair(conversations(spark, rows)).collect()) == in_order(plain_conversations(rows))


def test_repairs_of_the_given_conversations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in docs.collect()]
    got = repair.repair(docs)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert in_order(got.collect()) == in_order(plain_conversations(rows))


def test_conversations_at_the_edges(spark):
    assert repair.repair(conversations(spark, [])).collect() == []
    dropped = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (None, None, None, None), (5, 2**62, "user", "x" * 300_000), (5, -(2**62), "assistant", "A."), (5, 2**62 + 1, "assistant", "A.")]
    assert in_order(repair.repair(conversations(spark, rows)).collect()) == in_order([(c, min(r[0], 2**63 - 1), *r[1:]) for c, *r in plain_conversations(rows)])


def test_each_node_is_made_once():
    strings = sorted({"".join(random.Random(i).choice("uaUd") for _ in range(i % 9)) for i in range(300)})
    automaton = repair.Automaton(repair.ENDED)
    for s in strings:
        automaton.solve(s)
    assert automaton.made == len({s[:k] for s in strings for k in range(1, len(s) + 1)})
