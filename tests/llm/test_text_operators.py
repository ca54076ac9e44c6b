"""Token ids, attribution, line dedup, decontamination, toxicity and mixing against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wachter.llm import decontaminate, line_dedup, mixing, token_counts, token_ids, toxicity
from wachter.llm.common import Tokens, prefix_sum, regroup, shingle_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and odd texts, repeats, other scripts and white space.
ODD = [None, "", " ", "\n", "\n\n\n", "a", "a b c", "  lead", "trail  ", "tab\tand\nfeed\r\nend", "é à b  c\u0085d", "日本語 テキスト 😀 👩‍👩‍👧", "it's 'quoted' don't", "12 3,456.7 $8 -9%", "x" * 3000, "<|endoftext|> in text", "\x1c\x1d mixed\x0b\x0c", "aé aé é", "word. Word! WORD?", "a\n b\n\n c \nd"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, vocab=200):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocab}" for _ in range(n))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_tokens_and_batches():
    texts = [*ODD, *(prose(random.Random(i), 30) for i in range(5))]
    t = Tokens(pa.array(texts))
    low = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(x)] for x in texts]
    assert t.lens.tolist() == [len(w) for w in low]
    flat = [w for x in low for w in x]
    seen = {}
    for w, h in zip(flat, t.hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sh, n = shingle_hashes(t.hashes, t.lens, 5)
    grams = [tuple(w[i : i + 5]) for w in low for i in range(max(1, len(w) - 4)) if w]
    assert len(sh) == len(grams) == n.sum() and len(set(sh.tolist())) == len(set(grams))
    b = pa.record_batch({"t": pa.array(texts * 50)})
    assert [x for r in regroup(iter([b, b.slice(0, 0), b]), 3000) for x in r.column(0).to_pylist()] == texts * 100


def test_prefix_sum(spark):
    rows = [(i * 7 % 101, i % 4) for i in range(101)]
    got = {r["k"]: r["s"] for r in prefix_sum(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", "s").collect()}
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v


def test_token_ids_equal_whole_encodings(spark):
    rng = random.Random(4)
    alphabet = "ab é.,'\n\t 1😀  日-Zßñ"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200))]
    df = docs(spark, texts).withColumn("ids", F.lit("clash"))
    t = token_ids.tokenizer(token_ids.default_tokenizer())
    got = token_ids.digest(df).orderBy("doc_id").collect()
    start = 0
    for r, x in zip(got, texts, strict=True):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_ids.digest(docs(spark, [])).count() == 0
    twice = docs(spark, ["b", "a"]).withColumn("doc_id", F.lit(None).cast("long")).union(docs(spark, ["c c"], 5)).union(docs(spark, ["c c"], 5))
    assert sorted((r["doc_id"] is None, r["start"]) for r in token_ids.digest(twice).collect()) == [(False, 4), (False, 7), (True, 0), (True, 2)]


def test_orc_files_prune(spark, tmp_path):
    out = str(tmp_path / "orc")
    token_ids.write_orc(docs(spark, [f"text {i}" for i in range(300)]), out, files=4)
    got = token_ids.read_orc(spark, out)
    one = got.where("doc_id = 77")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()
    spans = got.groupBy(F.input_file_name()).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:], strict=False))


def test_orc_files_have_indexes(spark, tmp_path):
    """Row indexes at their stride, and Bloom filters on the id alone."""
    out = tmp_path / "orc"
    token_ids.write_orc(docs(spark, [f"text {i} " * 20 for i in range(5000)]), str(out), files=1)
    jvm, path = spark._jvm, str(next(out.glob("*.orc")))
    orc = jvm.org.apache.orc
    reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 1000 and reader.getNumberOfRows() == 5000 and reader.getStripes()[0].getIndexLength() > 0
    names = list(reader.getSchema().getFieldNames())
    every = spark.sparkContext._gateway.new_array(jvm.boolean, len(names) + 2)
    for i in range(len(names) + 2):
        every[i] = True
    index = reader.rows().readRowIndex(0, every, every)
    column = 1 + names.index("doc_id")
    assert index.getRowGroupIndex()[column].getEntryCount() == 5
    filters = index.getBloomFilterIndex()
    assert filters[column].getBloomFilterCount() == 5 and filters[1 + names.index("ids")] is None


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(spark, rule):
    rng = random.Random(7)
    texts = [x for x in ODD if x] + ["".join(rng.choice("ab é.\n 日😀don't") for _ in range(40)) for _ in range(40)]
    spans = []
    for x in texts:
        cuts = sorted(rng.sample(range(len(x) + 1), min(3, len(x) + 1)))
        spans.append([(f"s{k}", a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    df = spark.createDataFrame([(i, x, s) for i, (x, s) in enumerate(zip(texts, spans, strict=True))], "doc_id long, text string, sec array<struct<section:string,start:int,end:int>>")
    got = {(r["doc_id"], r["section"]): (r["tokens"], r["crossing"], r["total"]) for r in token_counts.attribute(df, "sec", rule).collect()}
    t, size = token_ids.tokenizer(token_ids.default_tokenizer()), token_counts.byte_lengths(token_ids.default_tokenizer())
    for i, (x, sec) in enumerate(zip(texts, spans, strict=True)):
        ids = t.encode(x, add_special_tokens=False).ids
        ends = np.cumsum(size[ids])
        assert ends[-1] == len(x.encode())
        lim = [(n, len(x[:a].encode()), len(x[:b].encode())) for n, a, b in sec]
        want = {n: [0, 0] for n, *_ in lim}
        for e, s in zip(ends, size[ids], strict=True):
            b = e - s
            best = None
            for n, lo, hi in lim:
                inside = min(e, hi) - max(b, lo)
                ok = inside > 0 and (rule == "overlap" or (lo <= b < hi if rule == "start" else lo < e <= hi))
                if ok and (best is None or (rule == "overlap" and inside > best[1])):
                    best = (n, inside)
            if best:
                want[best[0]][0] += 1
                want[best[0]][1] += best[1] < s
        for n, (a, c) in want.items():
            assert got[i, n] == (a, c, len(ids)), (rule, x, n)


def test_attribution_edges(spark):
    rows = token_counts.digest(docs(spark, [None, "", "one line", "a\nb", "a\nb\nc\nd", "\n"])).collect()
    assert {r["doc_id"] for r in rows} == set(range(6))
    sums = defaultdict(int)
    for r in rows:
        sums[r["doc_id"]] += r["tokens"]
    assert all(sums[r["doc_id"]] == r["total"] for r in rows)
    with pytest.raises(ValueError):
        token_counts.attribute(docs(spark, ["a"]), F.array(), "middle")


def brute_lines(rows, least):
    first, wins = {}, []
    for d, t in rows:
        L = (t or "").split("\n") if t else []
        n = [len(words(x)) for x in L]
        own = set()
        for s in range(len(L)):
            c = 0
            for e in range(s, len(L)):
                c += n[e]
                if c >= least:
                    own.add((s, e - s + 1))
                    break
            c = 0
            for b in range(s, -1, -1):
                c += n[b]
                if c >= least:
                    own.add((b, s - b + 1))
                    break
        wins += [(d, s, k, tuple(L[s : s + k])) for s, k in sorted(own)]
    for d, s, _, key in wins:
        first[key] = min(first.get(key, (d, s)), (d, s))
    gone = defaultdict(set)
    for d, s, k, key in wins:
        fd, fs = first[key]
        if (fd, fs) != (d, s):
            gone[d] |= set(range(max(s, fs + k) if fd == d else s, s + k))
    return gone


def test_line_dedup(spark):
    rng = random.Random(9)
    pool = [prose(rng, rng.randint(0, 9), 40) for _ in range(25)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [texts[3], "x\n" + texts[4] + "\ny", "same line here\n" * 8, *[x for x in ODD]]
    rows = list(enumerate(texts))
    gone = brute_lines(rows, 12)
    df = docs(spark, texts).withColumns({c: F.lit("clash") for c in ("pos", "_h", "_g", "_d", "runs", "n_lines", "d", "t", "row", "from")})
    got = line_dedup.edited(df, 12).select("row.doc_id", "text", "n_lines", "n_deleted").collect()
    out = line_dedup.deduplicate(df, 12)
    assert out.columns == df.columns and {(r["doc_id"], r["text"], r["_h"], r["d"]) for r in out.collect()} == {(r["doc_id"], r["text"], "clash", "clash") for r in got}
    assert sum(map(len, gone.values())) > 30 and len(got) == len(rows)
    for r in got:
        t = rows[r["doc_id"]][1]
        L = (t or "").split("\n")
        assert r["n_lines"] == len(L) and r["n_deleted"] == len(gone[r["doc_id"]])
        want = t if not gone[r["doc_id"]] else "\n".join(x for i, x in enumerate(L) if i not in gone[r["doc_id"]])
        assert r["text"] == want
    assert line_dedup.digest(docs(spark, [])).count() == 0
    r = line_dedup.digest(docs(spark, ["a " * 60 + "\nb", "a " * 60 + "\nb"]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert [x["n_deleted"] for x in r] == [0, 0]  # alike in id and text: one document
    r = {x["doc_id"]: x for x in line_dedup.digest(docs(spark, ["a " * 60 + "\nb", "q\n" + "a " * 60])).collect()}
    assert (r[0]["n_deleted"], r[1]["n_deleted"]) == (0, 1) and r[1]["text_md5"] == hashlib.md5(b"q").hexdigest()


def test_line_dedup_of_long_texts(spark):
    """Windows of a text with many empty lines overlap; what is deleted is merged, so the work follows the lines, not their square."""
    n = 20_000
    texts = ["one" + "\n" * n + "two", "one" + "\n" * n + "two", "two\n\none", "word " * 300_000, "a\n" * n]
    got = {r["doc_id"]: r for r in line_dedup.digest(docs(spark, texts)).collect()}
    assert [(got[i]["n_lines"], got[i]["n_deleted"]) for i in range(5)] == [(n + 1, 0), (n + 1, n + 1), (3, 2), (1, 0), (n + 1, n - 1)]
    runs = line_dedup.repeated_runs(docs(spark, texts)).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs} == {1: [(0, n + 1)], 2: [(0, 1), (2, 3)], 4: [(1, n)]}


def test_line_dedup_deletes_short_lines(spark):
    rng = random.Random(10)
    long = [prose(rng, 60) for _ in range(2)]
    texts = [f"All rights reserved.\n\n{long[0]}\nyes", f"{long[1]}\n\nAll rights reserved.\n\nno", "yes\nmaybe\n", "\n\n", " \nyes no", *ODD]
    rows = list(enumerate(texts))
    gone = brute_lines(rows, 1)
    got = {r["doc_id"]: r for r in line_dedup.edited(docs(spark, texts)).select("row.doc_id", "text", "n_deleted").collect()}
    assert got[1]["text"] == f"{long[1]}\n\nno" and got[2]["text"] == "maybe\n" and got[3]["text"] == "\n\n"
    for i, t in rows:
        assert got[i]["n_deleted"] == len(gone[i])
        assert got[i]["text"] == (t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))


def test_decontamination(spark):
    rng = random.Random(5)
    clean = [prose(rng, 60) for _ in range(30)]
    item = "The train left Berlin at 9 with 120 people and Maria counted 45 km before the driver stopped near Hamburg at 11 for the second time"
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "tiny item of five words"), (4, "what is the sum of 3 and 4 if 3 is added to 4 twice by Tom")], "item_id long, text string")
    same = clean[0] + " " + item + " " + clean[1]
    moved = item.replace("Berlin", "Paris").replace("Maria", "Claire").replace("120", "77").replace("45 km", "30 miles").replace(" 9 ", " 8 ").replace("11", "10")
    good = "so what is the sum of 5 and 6 if 5 is added to 6 twice by Ann ok"
    broken = "so what is the sum of 5 and 6 if 7 is added to 8 twice by Ann ok"  # 3 is 5 and 7
    texts = [*clean, same, "intro " + moved, good, broken, "a tiny item of five words indeed", item.upper(), *ODD]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.digest(docs(spark, texts), bench).collect()}
    k = len(clean)
    assert got == {(k, 0), (k + 1, 0), (k + 2, 4), (k + 4, 3), (k + 5, 0)}
    left = decontaminate.decontaminate(docs(spark, texts), bench)
    assert left.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and left.count() == len(texts) - len({d for d, _ in got})
    assert decontaminate.decontaminate(docs(spark, texts), bench.limit(0)).count() == len(texts)
    assert decontaminate.digest(docs(spark, []), bench).count() == 0


def brute_matches(texts, items, n=8, share=0.5, least=4):
    """Windows looked for at every place of every text; words are told apart as the operator does."""

    def read(text):
        out, number, opens = [], False, True
        for m in re.finditer(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", text or ""):
            word, flags = decontaminate._describe(m[0])
            is_number = bool(flags & decontaminate.IS_NUM)
            unit = bool(flags & decontaminate.IS_UNIT) and number and bool(out)
            name = bool(flags & decontaminate.IS_CAP) and not opens and not is_number and not unit
            kind = "#" if is_number else "@" if unit else None
            out.append((word, kind or ("*" if name else None), kind))
            number, opens = is_number, bool(flags & decontaminate.ENDS)
        return out

    def value(word):
        return int(Tokens(pa.array([word or "_"]), lower=False).hashes[0].view(np.int64))

    def codes(words, rule):  # a slot's kind, or the word
        return [(w if rule == "exact" else (a if rule == "names" else b) or f"={w}") for w, a, b in words]

    found = set()
    for i, item in enumerate(items):
        q = read(item)
        k = min(n, len(q))
        windows = {"names": set(), "blind": set(), "exact": set()}
        for p in range(len(q) - k + 1) if q else ():
            for rule, at in (("names", 1), ("blind", 2)):
                if sum(x[at] is None for x in q[p : p + k]) >= min(least, k):
                    windows[rule].add(p)
            if p not in windows["names"]:
                windows["exact"].add(p)
        every = set().union(*windows.values())
        for d, text in enumerate(texts):
            t = read(text)
            hits = {r: [] for r in windows}  # (shift, window)
            for rule, own in windows.items():
                a, b = codes(q, rule), codes(t, rule)
                hits[rule] = [(s - p, p) for p in own for s in range(len(b) - k + 1) if a[p : p + k] == b[s : s + k]]
            for rules, total in ((["names"], windows["names"]), (["blind"], windows["blind"]), (list(windows), every)):
                got = set()
                for shift in {s for r in rules for s, _ in hits[r]}:
                    here = {(p, tuple(sorted({(value(q[x][0]), value(t[x + shift][0])) for x in range(p, p + k) if q[x][1]}))) for r in rules for s, p in hits[r] if s == shift}
                    votes = Counter(pair for p, pairs in here for pair in pairs)
                    left, right = {}, {}
                    for (x, y), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
                        if x not in left and y not in right:
                            left[x], right[y] = y, x
                    got |= {p for p, pairs in here if all(left.get(x) == y for x, y in pairs)}
                if total and got and len(got) >= share * len(total):
                    found.add((d, i))
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    names, units, plain = ["Anna", "Bert", "Oslo", "Rome"], ["km", "kg", "hours"], [f"p{i}" for i in range(40)]

    def piece(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out += [str(rng.randint(1, 12))] + ([rng.choice(units)] if rng.random() < 0.4 else []) if x < 0.2 else [rng.choice(names)] if x < 0.3 else [rng.choice(plain) + ("." if rng.random() < 0.05 else "")]
        return " ".join(out)

    def changed(item):
        w = item.split()
        swap = dict(zip(names, rng.sample(names, 4), strict=True)) | {str(i): str(rng.randint(1, 30)) for i in range(13)}
        w = [swap.get(x, x) for x in w] if rng.random() < 0.6 else w
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice([str(rng.randint(1, 12)), rng.choice(names), rng.choice(plain)])
        return rng.choice([str, str, str.lower, str.upper])(" ".join(w))

    items = [piece(rng.choice([3, 7, 8, 9, 14, 25, 40])) for _ in range(25)] + [None, ""]
    texts = [" ".join([piece(rng.randint(0, 30)), changed(rng.choice(items[:25])), piece(rng.randint(0, 30))]) for _ in range(120)] + ODD
    want = brute_matches(texts, items)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.digest(docs(spark, texts), bench).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_decontamination_scores_windows(spark):
    """A changed slot costs the windows that hold it, not the match."""
    item = " ".join(f"word{i}" for i in range(20)) + " 7 apples and 7 pears " + " ".join(f"more{i}" for i in range(20))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    texts = [item.replace("7 pears", "9 pears"), item.replace(" 7 ", " 9 "), item]
    got = {r["doc_id"]: (r["matched"], r["windows"]) for r in decontaminate.digest(docs(spark, texts), bench).collect()}
    assert got[1] == got[2] == (38, 38) and got.keys() == {0, 1, 2} and 19 <= got[0][0] < 38


def test_decontamination_ignores_case(spark):
    rng = random.Random(6)
    item = "The train left Berlin at 9 with 120 people and Maria counted 45 km before the driver stopped near Hamburg at 11 for the second time"
    bench = spark.createDataFrame([(0, item), (1, prose(rng, 30))], "item_id long, text string")
    around = [prose(rng, 40) for _ in range(2)]
    half = item[: len(item) // 2].upper() + item[len(item) // 2 :].replace("Hamburg", "Paris")
    other = item.lower().replace("9", "8").replace("120", "77").replace("45 km", "30 miles").replace("11", "10")
    texts = [item.upper(), item.lower(), item.title(), other, half, " ".join([around[0].upper(), item.upper(), around[1].upper()]), *around, around[0].upper(), item.lower().replace("9", "8").replace("120", "8").replace("11", "8"), *ODD]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.digest(docs(spark, texts), bench).collect()}
    assert got == {(i, 0) for i in range(6)}
    assert decontaminate.decontaminate(docs(spark, texts), bench).count() == len(texts) - 6


def test_decontamination_of_dense_items(spark):
    rng = random.Random(7)
    table = "Alice 12 Bob 15 Carol 9 Dave 31 Erin 4 Frank 77 Grace 5 Heidi 8"
    mixed = table + " and then all of the children went back home to eat their supper with the rest of us"
    items = ["Who wrote Pride and Prejudice?", table, "12 + 15 = 27", mixed, "3 4 5"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    around = [prose(rng, 40) for _ in range(2)]
    inside = [f"{around[0]} {x} {around[1]}" for x in items[:3]]
    tail = around[0] + mixed[len(table) :]
    texts = [*inside, table.lower(), table.upper(), tail, table.replace("12", "13").replace("31", "30").replace("5", "6"), table.replace("Bob", "Tom").replace("Erin", "Ann").replace("Heidi", "Jane"), "who wrote Emma and Persuasion?", "12 + 16 = 28", *around, *ODD]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.digest(docs(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 1), (4, 1), (5, 3), (6, 1)}


def toxic_set(rng, n):
    bad = ["vile", "rotten", "foul"]
    rows, marks = [], []
    for i in range(n):
        y = int(rng.random() < 0.2)
        w = prose(rng, rng.randint(5, 40)).split()
        for _ in range(3 * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append(" ".join(w))
        marks.append((i, y))
    return rows, marks


def test_toxicity(spark):
    texts, marks = toxic_set(random.Random(2), 1500)
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    df = docs(spark, [*texts, *ODD]).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in toxicity.digest(df, labels).collect()}
    assert len(got) == len(texts) + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(got[i]["score"], y) for i, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in marks)
    p, n = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in p for b in n]) > 0.98 and np.mean([s >= 0.5 for s in p]) > 0.9 and np.mean([s >= 0.5 for s in n]) < 0.05
    assert got[len(texts)]["score"] == got[len(texts) + 1]["score"] < 0.5  # null and empty
    again = {r["doc_id"]: r["score"] for r in toxicity.digest(df, labels).collect()}
    assert again == {k: r["score"] for k, r in got.items()}
    nothing = toxicity.digest(docs(spark, ["a"]), labels.limit(0)).collect()
    assert len(nothing) == 1 and nothing[0]["predicted"] == 0
    assert toxicity.digest(docs(spark, []), labels).count() == 0


def test_ftrl_equals_a_plain_one(spark):
    """The vectorised learner against one with dictionaries, example by example; features against their definition."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 25), 30).replace("w1", "W1,") for _ in range(120)] + ["", "one"]
    labels = [int("w7" in t.split()) for t in texts]
    low = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()) for t in texts]
    t = Tokens(pa.array(texts), toxicity.NOT_WORD)
    doc, at = toxicity.features(t)
    names = [[*((w,) for w in x), *zip(x, x[1:], strict=False), *((a, None, b) for a, b in zip(x, x[2:], strict=False))] for x in low]
    mine = [Counter(at[doc == i].tolist()) for i in range(len(texts))]
    assert [sum(c.values()) for c in mine] == [len(x) for x in names]
    words_ = {w for x in low for w in x}
    single = {w: toxicity.features(Tokens(pa.array([w]), toxicity.NOT_WORD))[1].tolist() for w in words_}
    assert all(len(v) == 1 for v in single.values()) and len({v[0] for v in single.values()}) == len(words_)
    assert all(mine[i][single[w][0]] >= Counter(x)[w] for i, x in enumerate(low) for w in x)

    df = spark.createDataFrame([(f"k{i}", x, y) for i, (x, y) in enumerate(zip(texts, labels, strict=True))], "key string, text string, label int")
    got = {r["bucket"]: r["weight"] for r in toxicity.fit(df, epochs=3, min_seen=2, positive=2, seed=5).collect()}
    order = [int(r["key"][1:]) for r in df.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key", F.xxhash64("text")).collect()]
    rows = [set(mine[i]) for i in order]
    seen = Counter(f for r in rows for f in r)
    bias = 1 << toxicity.BITS
    rows = [{f for f in r if seen[f] >= 2} | {bias} for r in rows]
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        limit = 0.0 if f == bias else toxicity.L1
        if abs(z[f]) <= limit:
            return 0.0
        return -(z[f] - np.sign(z[f]) * limit) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    shuffle = np.random.default_rng(5)
    for _ in range(3):
        for i in shuffle.permutation(len(rows)):
            y = labels[order[i]]
            for _ in range(2 if y else 1):
                w = {f: weight(f) for f in rows[i]}
                g = 1 / (1 + np.exp(-sum(w.values()))) - y
                for f in rows[i]:
                    z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / toxicity.ALPHA * w[f]
                    n[f] += g * g
    want = {f: weight(f) for f in z if weight(f)}
    assert got.keys() == want.keys() and bias in got and all(got[f] == pytest.approx(want[f], rel=1e-6) for f in want)


def test_toxicity_sample(spark):
    """Rows in the order of the id's hash, whole texts of any length, until one of the two bounds; copies of a row are one."""
    texts = ["x" * (10 * i) for i in range(100)]
    df = docs(spark, texts).union(docs(spark, texts[:3]))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 1), (3, 0), (None, 1), (500, 1)], "doc_id long, toxic int")
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    every = toxicity.sample(df, labels).collect()
    assert sorted(int(r["key"]) for r in every) == learned and {r["key"]: r["label"] for r in every}["3"] == 1 and max(len(r["text"]) for r in every) >= 980
    order = [int(r["k"]) for r in spark.createDataFrame([(str(i),) for i in learned], "k string").orderBy(F.xxhash64("k")).collect()]
    assert {int(r["key"]) for r in toxicity.sample(df, labels, max_rows=20).collect()} == set(order[:20])
    upto, total = 0, 0
    while total < 5000:
        total += len(texts[order[upto]])
        upto += 1
    assert {int(r["key"]) for r in toxicity.sample(df, labels, max_chars=5000).collect()} == set(order[:upto])


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, cap = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}
    fixed: set = set()
    while True:
        rest = total - sum(cap[s] for s in fixed)
        free = [s for s in sizes if s not in fixed]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free} | {s: cap[s] for s in fixed}
        over = {s for s in free if t[s] > cap[s]}
        if not over:
            return t
        fixed |= over


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 80)), s) for i, s in enumerate([f"src{min(int(rng.paretovariate(1)), 9)}" for _ in range(900)] + [None] * 20 + ["tiny"] * 2)]
    rows += [rows[5], rows[5], (None, "a b", "src1"), (2000, None, "src1"), (2001, "", "blank")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.digest(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 20 for s in sizes)
    key = lambda rs: sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in rs)
    assert key(mixing.digest(df.repartition(7)).collect()) == key(got)
    small = {(str(r["doc_id"]), str(r["source"])): r["repeats"] for r in mixing.plan(df, cell=50).collect()}
    assert len(small) == len(rows) - 2
    out = mixing.mix(df)
    assert out.columns == df.columns and sum(len(words(r["text"])) for r in out.collect()) == sum(taken.values())
    assert mixing.digest(df.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for n in (3, 50, 4000):
        p, size = np.full(n, 0.3), rng.integers(1, 1000, n).astype(float)
        q = mixing.flight(p, size, np.ones(n), rng)
        assert q @ size == pytest.approx(p @ size) and q.sum() == pytest.approx(p.sum()) and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    hits = np.mean([mixing.flight(np.full(9, 0.4), np.arange(1.0, 10), np.ones(9), np.random.default_rng(k)) for k in range(4000)], 0)
    assert np.abs(hits - 0.4).max() < 0.04  # each document's chance is its probability
