from sightline.llm import decontaminate


def test_blocks_are_read_one_ahead(spark, monkeypatch):
    """While a block's windows are made, no more than the next block has been read; results are those of one block."""
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcd"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x y {t} z") for k, t in enumerate(texts)] + [(9, "none of them")], "doc_id long, text string")
    read, seen, plain, made = [], [], decontaminate.blocks, decontaminate.Windows.__init__

    def blocks(*a):
        for b in plain(*a):
            read.append(b)
            yield b

    monkeypatch.setattr(decontaminate, "blocks", blocks)
    monkeypatch.setattr(decontaminate.Windows, "__init__", lambda self, block, n: seen.append(len(read)) or made(self, block, n))
    rows = lambda size: sorted(map(tuple, decontaminate.find(docs, items, block_words=size).collect()), key=str)
    got = rows(20)
    assert seen == [2, 3, 4, 4]
    assert got == rows(1000) and sum(len(r[2]) for r in got) == 4
