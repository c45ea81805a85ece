import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_rules_and_leaks import brute as brute_leaks


def brute_without(docs, n=20):
    rows = {d: (t or "").encode().split() for d, t in docs}
    first, out = {}, {}
    for d in sorted(rows):
        for i in range(len(rows[d]) - n + 1):
            first.setdefault(tuple(rows[d][i : i + n]), (d, i))
    for d, t in docs:
        w = rows[d]
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] != (d, i) for j in range(i, i + n)}
        out[d] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t
    return out


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    some = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, items = some(30), [(i, some(15)) for i in range(3)]
    docs = []
    for i in range(250):
        kind = i % 10
        text = some(r.randint(30, 120))
        if kind == 1:
            text = text.upper().replace(" ", "!! ")
        elif kind == 2 and docs:
            text = docs[-2][1].replace("w7 ", "w8 ") + "\nend"
        elif kind == 3:
            text += "\n" + passage + " " + some(5)
        elif kind == 4:
            text += " " + items[i % 3][1]
        docs.append((i, text))
    docs += [(900, ""), (901, "one"), (902, None)]
    table = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 1)) for i in range(250)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, texts = now.columns, {}
    for k, (_, stage) in enumerate(C.STAGES):
        before = sorted((x.doc_id, x.text) for x in now.collect()) if k else docs
        now = stage(spark, now, str(tmp_path))
        if k == 4:
            break
        assert now.columns == columns
        now.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        texts = {x.doc_id: x.text for x in now.collect()}
        if k == 0:
            assert all((i in texts) == (i % 10 != 1) for i in range(250))
        elif k == 1:
            groups = brute_groups(before, 5, 80)
            assert set(texts) == {d for d, (_, c) in groups.items() if d == c} and len(texts) < len(before)
        elif k == 2:
            assert texts == brute_without(before) and texts != dict(before)
        elif k == 3:
            assert set(texts) == {d for d, _, hit, _ in brute_leaks(before, items, 10) if not hit} and len(texts) < len(before)
    exact, lengths = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    rows = now.collect()
    for x in rows:
        lengths[x.doc_id] = lengths.get(x.doc_id, 0) + x.length
    assert lengths == {d: len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    assert sorted((x.doc_id, x.piece, x.length) for x in C.run(spark, str(tmp_path)).collect()) == sorted((x.doc_id, x.piece, x.length) for x in rows)
