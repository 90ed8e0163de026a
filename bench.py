"""Benchmark: headline corpus jobs and every registered query on ``$BENCH_SF_DIR``.

Prints one JSON line: ``{"metric", "value" (total seconds), "unit", "queries": {name: sec},
"sf", "throughput": {...}}``. Each query is forced to completion with the ``noop`` sink (no
driver collect); the headline jobs also report tokens or windows per second. Before timing, the
three headline jobs run twice on a smaller fixture (``$BENCH_WARMUP_DIR``, default sf0.01) so
that JVM code generation and Python worker start-up are not counted as throughput.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARMUP_DIR = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.01")
os.environ.setdefault("CORPUSPACK_DRIVER_MEMORY", "6g")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))


def _force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from pyspark.sql import functions as F

    from corpuspack.functions.tokens import ByteTokenizer
    from corpuspack.operators import packing, windows
    from corpuspack.plans.queries import QUERIES, SOURCE_ORDER
    from corpuspack.session import local_session, scratch_dir
    from corpuspack.sources import sinks
    from corpuspack.sources.registry import fixture_docs

    spark = local_session(CPUS, shuffle_partitions=int(CPUS) * 2, app="corpuspack-bench")
    times: dict[str, float] = {}
    thr: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    def headline(sf_dir: str, record: bool) -> None:
        # as a job would find them: in files for every core (the fixture is a single file, so a single task)
        files = f"{scratch_dir(spark)}/bench-docs-{int(time.time() * 1000)}"
        fixture_docs(spark, sf_dir).repartitionByRange(2 * int(CPUS), "source", "doc_seq").write.parquet(files)
        docs = spark.read.parquet(files)
        total_tokens, text_mb = docs.select(
            F.sum(ByteTokenizer().count("text")), F.sum(F.octet_length(F.encode("text", "UTF-8"))) / 1e6
        ).first()

        def run(name, fn):
            t0 = time.perf_counter()
            fn()
            if record:
                times[name] = round(time.perf_counter() - t0, 3)

        # 1. tokenize every document (ids + EOS as arrays), no budget: the plan a job runs
        tok = packing.tokenize(packing.nonempty(docs))
        run("tokenize_all", lambda: _force(tok.select(F.size("tokens"))))

        # 2. pack every token into 1 Mi-token shards and write them (counts, offsets, cut, split, write)
        out = f"{scratch_dir(spark)}/bench-packed-{int(time.time() * 1000)}"
        run("pack_all", lambda: packing.pack(
            docs, shard_tokens=1 << 20, targets=None, batch_docs=1000,
            piece_tokens=8192).write(out))

        # 3. one epoch of 2,048-token training windows over the packed shards
        seq_len, block = 2048, 8192  # shards were cut at the block size
        seg = sinks.read_packed(spark, out)
        inv = packing.shard_inventory(seg)
        n_windows = total_tokens // seq_len

        def cut():
            d = windows.draw_windows(spark, inv, n_windows, seq_len, 1337, SOURCE_ORDER)
            w = windows.cut_windows(d, windows.aligned_blocks(windows.drawn_shards(seg, d), block), seq_len, block)
            _force(w.select("sample_id", F.size("x")))

        run("windows_epoch", cut)
        if record:
            thr["tokenize_tok_per_s"] = round(total_tokens / times["tokenize_all"])
            # bytes are what compares: byte ids and subword ids differ several times in number
            thr["tokenize_text_mb_per_s"] = round(text_mb / times["tokenize_all"], 1)
            thr["pack_text_mb_per_s"] = round(text_mb / times["pack_all"], 1)
            thr["pack_tok_per_s"] = round(total_tokens / times["pack_all"])
            thr["windows_per_s"] = round(n_windows / times["windows_epoch"], 1)
            thr["tokens"] = int(total_tokens)

    if os.path.isdir(WARMUP_DIR):
        for _ in range(2):
            headline(WARMUP_DIR, record=False)
    headline(SF_DIR, record=True)

    # 4. every registered query, each with a plan of its own, the language-model operators where they are present
    try:
        from corpuspack.llm.queries import QUERIES as LLM_QUERIES
    except ModuleNotFoundError:
        LLM_QUERIES = {}
    for name, q in {**QUERIES, **LLM_QUERIES}.items():
        timed(f"q_{name}", lambda q=q: _force(q(spark, SF_DIR)))

    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else SF_DIR,
        "cpus": int(CPUS),
        "throughput": thr,
        # each, hardware not stated; 4 bytes an id would be 12.8 MB/s of text
        "baseline": {"tokenize_tok_per_s": 3_200_000},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
