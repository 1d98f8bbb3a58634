"""Streamed questions with their turns equal a batch run; late turns are dropped."""

import json


from quillstone.streaming import questions as Q


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


def at(minute):
    return f"2024-05-01T{10 + minute // 60:02d}:{minute % 60:02d}:00Z"


def question(i, conv, minute, text="what is it"):
    return {"query_id": i, "conv_id": conv, "question": text, "asked_at": at(minute)}


def turn(conv, n, minute, role="user", text="the pay of a clerk"):
    return {"conv_id": conv, "turn": n, "role": role, "text": text, "said_at": at(minute)}


ASKED = [question(1, "a", 30), question(2, "a", 100), question(3, "b", 31), question(4, None, 32)]
SAID = [turn("a", 1, 5), turn("a", 2, 6, "assistant", "see the table"), turn("a", 2, 6, "assistant", "see the table"), turn("a", 3, 70), turn("b", 1, 40), turn("z", 1, 30)]
LATER = [question(90, "z", 400)], [turn("z", 9, 400)]  # they move the watermarks on


def test_stream_equals_batch(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    got = {}

    def answer(qs, turns):
        got.update({r.query_id: [] for r in qs.collect()})
        for r in sorted(turns.collect()):
            got[r.query_id].append((r.turn, r.role, r.text))

    def run():
        read = lambda name, schema: spark.readStream.schema(schema).json(str(tmp_path / name))
        q = Q.follow(read("q", Q.QUESTIONS), read("t", Q.TURNS), answer, str(tmp_path / "cp"))
        assert q.awaitTermination(60)

    try:
        put(tmp_path / "q" / "1.json", ASKED)
        put(tmp_path / "t" / "1.json", SAID)
        run()
        put(tmp_path / "q" / "2.json", LATER[0])
        put(tmp_path / "t" / "2.json", LATER[1])
        run()
        put(tmp_path / "t" / "3.json", [turn("a", 4, 99, text="too late")])
        put(tmp_path / "q" / "3.json", [question(5, "a", 101)])  # too late as well
        run()
        table = lambda rows, schema: spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
        want = {r.query_id: [tuple(t) for t in r.turns] for r in Q.with_turns(table(ASKED, Q.QUESTIONS), table(SAID, Q.TURNS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert want == {1: [(1, "user", "the pay of a clerk"), (2, "assistant", "see the table")], 2: [(3, "user", "the pay of a clerk")], 3: [], 4: []}
    assert {k: v for k, v in got.items() if k < 90} == want
