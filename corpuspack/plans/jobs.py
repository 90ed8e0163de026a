"""End-to-end jobs: prepare a corpus mixture, export training windows, build instruction sets.

    python -m corpuspack.plans.jobs prepare --source fineweb-edu=/data/fwe --source the-stack=/data/stack \\
        --scale validate --out /shared/packed
    python -m corpuspack.plans.jobs windows --packed /shared/packed --out /shared/windows \\
        --seq-len 2048 --epochs 1 --micro-batch 8 --grad-accum 6 --ranks 4
    python -m corpuspack.plans.jobs windows --bin-dirs /shared/bin/fineweb-edu,/shared/bin/the-stack ...
    python -m corpuspack.plans.jobs prompts --rows /data/rows --responses /data/answers --out /shared/chats
    python -m corpuspack.plans.jobs tuning --jsonl /shared/chats --out /shared/tuning
    python -m corpuspack.plans.jobs pairs --prefs /data/prefs --out /shared/pairs

All run on whatever cluster the session belongs to; every folder must be shared storage.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.functions.tokens import ByteTokenizer, Tokenizer
from corpuspack.operators import instruct, mixture, packing, window_reads, windows
from corpuspack.session import materialize
from corpuspack.sources import binshards, footers, registry, sinks, tokenshards


def budget_prefix(
    spark: SparkSession,
    name: str,
    files: Sequence[str],
    target: int | None,
    shard_tokens: int,
    batch_docs: int,
    tokenizer: Tokenizer,
    first_files: int = 1,
    fmt: str = "parquet",
) -> list[str]:
    """The stream-order prefix of ``files`` that decides the source's budget cut.

    The stream stops at the first document-batch end whose running total reaches
    ``ceil(T / S) * S``; that end lies at most ``batch_docs`` documents after the document
    that crosses the rounded target. So files are counted in groups that double in size (one
    distributed job per group: per-group tokens and documents, no rows to the driver) until the
    total has crossed it and ``batch_docs`` more documents have been read. Packing that prefix
    gives the same shards as packing the whole source. As groups double and one more may follow the
    crossing, the prefix holds up to about four times the needed text (if files are even), and is
    scanned once here and twice by the packing. Without a target every file is needed.
    """
    if target is None:
        return list(files)
    S = int(shard_tokens)
    rounded = -(-int(target) // S) * S
    read, size, total, after = 0, max(1, first_files), 0, None
    while read < len(files):
        group = list(files[read:read + size])
        docs = registry.text_scan(spark, registry.lookup(name), group, fmt)
        t = packing.nonempty(docs.select("text"))
        n_tok, n_docs = t.agg(F.sum(tokenizer.count("text")), F.count(F.lit(1))).first()
        read += len(group)
        size *= 2
        if after is not None:
            after += int(n_docs or 0)
        total += int(n_tok or 0)
        if after is None and total >= rounded:
            after = 0  # crossed inside this group: the stopping batch end may still be ahead
            continue
        if after is not None and after >= batch_docs:
            break
    return list(files[:read])


def prepare_corpus(
    spark: SparkSession,
    sources: Mapping[str, str],
    out: str,
    targets: packing.Targets = packing.DEFAULT_TARGET,
    shard_tokens: int = packing.DEFAULT_SHARD_TOKENS,
    batch_docs: int = packing.DEFAULT_BATCH_DOCS,
    split: str | None = None,
    tokenizer: Tokenizer | None = None,
    bin_dir: str | None = None,
    force: bool = False,
    early_stop: bool = True,
    fmt: str = "parquet",
    piece_tokens: int | None = None,
) -> DataFrame | None:
    """Read registered sources (name → path), pack them in one job under per-source budgets and
    commit them as the new version of those sources under ``out`` (``sinks.write_packed``). A source that was made
    from the same files (path, length, time of change) with the same parameters is skipped, unless ``force``;
    a changed input, budget, shard size or tokenizer is prepared again. Returns the cut table of the sources packed now
    (None when there was nothing left to do). With ``early_stop`` each source is read only up to
    the rows that decide its cut (``footers``; JSON and stores that tasks cannot open: up to the file, ``budget_prefix``),
    as a stream would stop. With ``bin_dir``
    the shards are also exported as flat ``uint32`` files, for the sources not yet exported.
    With ``piece_tokens`` shards are also cut at its multiples, which ``export_windows`` takes as its
    blocks. ``targets`` as a mapping must name every source; None is no budget. ``fmt``: ``parquet`` or
    ``json`` (JSON lines)."""
    if isinstance(targets, Mapping) and (missing := sorted(set(sources) - set(targets))):
        raise ValueError(f"no target is given for {', '.join(missing)}")
    tokenizer = tokenizer or ByteTokenizer()
    budget = {name: targets[name] if isinstance(targets, Mapping) else targets for name in sources}
    listed = {name: registry.source_files(spark, sources[name], split, fmt) for name in sources}
    prints = {
        name: sinks.input_fingerprint(spark, listed[name], {
            "target": budget[name], "shard_tokens": shard_tokens, "batch_docs": batch_docs, "piece_tokens": piece_tokens, "format": fmt,
            "tokenizer": tokenizer.identity(),
        })
        for name in sources
    }
    todo = [name for name in sources if force or not sinks.is_prepared(spark, out, name, prints[name])]
    cut = None
    if todo:
        frames = []
        for name in todo:
            files, target, scan = listed[name], budget[name], None
            if not tokenizer.columnar:
                pass  # a document's tokens are known only when the whole corpus' are
            elif early_stop and target is not None and fmt == "parquet" and footers.readable(files):
                spec = registry.lookup(name)
                prefix, groups = footers.budget_prefix(spark, spec, files, target, shard_tokens, batch_docs, tokenizer)
                scan = prefix.scan(spark, spec, groups) if prefix.groups else None
            elif early_stop:
                files = budget_prefix(spark, name, files, target, shard_tokens, batch_docs, tokenizer, fmt=fmt)
            frames.append(registry.read_source(spark, name, sources[name], split, fmt, files=files, scan=scan))
        plan = packing.pack(
            mixture.union_sources(frames), shard_tokens=shard_tokens, targets=targets, batch_docs=batch_docs,
            tokenizer=tokenizer, piece_tokens=piece_tokens,
        )
        plan.write(out, todo, prints)
        cut = plan.cut
    if bin_dir:
        export = [name for name in sources if name in todo or not binshards.is_exported(spark, bin_dir, name)]
        if export:
            binshards.export_bin(sinks.read_packed(spark, out, export), bin_dir, export)
            cut = cut if cut is not None else spark.createDataFrame([], "source STRING, kept_tokens BIGINT, target BIGINT, n_shards BIGINT")
    return cut


def export_windows(
    spark: SparkSession,
    packed: str | Sequence[str],
    out: str,
    seq_len: int,
    n_samples: int | None = None,
    epochs: float = 1.0,
    seed: int = 1337,
    micro_batch: int = 8,
    grad_accum: int = 1,
    ranks: int = 1,
    block_tokens: int | None = None,
    source_order: Sequence[str] | None = None,
    piece_tokens: int | None = None,
) -> int:
    """Draw training windows from packed shards and write them per rank.

    ``packed`` is a packed Parquet folder, or a list of ``.bin`` shard folders (A7: the
    folder order numbers the shards, as the upstream loader's ``data_dirs`` do), from which each window is
    read by itself (``window_reads``).
    ``n_samples`` defaults to ``epochs`` passes over the unique tokens. ``source_order``
    numbers the shards of a Parquet folder; by default sources sort by name. ``piece_tokens``: the
    Parquet shards were prepared with it, so its multiples are the blocks and nothing is cut again.
    Returns the number of windows written.
    """
    if isinstance(packed, str):
        seg = sinks.read_packed(spark, packed)
        inventory = packing.shard_inventory(seg)
    else:
        files = tokenshards.files_table(spark, tokenshards.files_of(None, list(packed)))
        inventory = packing.shard_inventory(files)  # lengths from the manifests or file sizes: no ids are read
        source_order = source_order or tokenshards.source_names(packed)
    per_source = inventory.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()  # one row per source
    if not per_source:
        raise FileNotFoundError(f"no shards under {packed}")
    order = list(source_order) if source_order else sorted(r.source for r in per_source)
    if n_samples is None:
        n_samples = int(epochs * sum(r.n for r in per_source if r.source in order) // seq_len)
    block = piece_tokens or block_tokens or max(seq_len, 8192)
    draws = windows.draw_windows(spark, inventory, n_samples, seq_len, seed, order)
    if isinstance(packed, str):
        drawn = windows.drawn_shards(seg, draws)
        blocks = windows.aligned_blocks(drawn, block) if piece_tokens else windows.to_blocks(drawn, block)
        cut = windows.cut_windows(draws, blocks, seq_len, block)
    else:
        cut = window_reads.cut_windows_by_range(draws, files, seq_len, n_samples)
    windows.write_windows(windows.batch_layout(cut, micro_batch, grad_accum, ranks), out)
    return n_samples


def prompts_job(
    spark: SparkSession, rows: str, responses: str, out: str, n: int | None = None, seed: int = 0,
    rename: Mapping[str, str] | None = None, fmt: str = "json",
) -> int:
    """G1 + G2 + A9: seed prompts of a scanned instruction set, joined by ``id`` with the responses
    generated for them (JSON lines ``id, response``), written as chat JSONL. Returns the prompts taken."""
    scanned = materialize(registry.read_instruction_rows(spark, rows, fmt, dict(rename or {})), "job-rows")
    taken = scanned.count() if n is None else n
    prompts = instruct.seed_prompts(scanned, taken, seed, "id")
    answered = spark.read.schema("id BIGINT, response STRING").option("mode", "FAILFAST").json(responses)
    sinks.write_chat_jsonl(instruct.attach_responses(prompts, answered, "id"), out)
    return taken


def tuning_job(
    spark: SparkSession, out: str, chats: str | None = None, rows: str | None = None, jsonl: str | None = None,
    seed: int = 42, rename: Mapping[str, str] | None = None, tokenizer: Tokenizer | None = None,
) -> None:
    """G3 + B12 + B13: the tuning set of scanned sources, rendered, cut at 2,048 ids and written in the
    order of its permutation."""
    mix = instruct.tuning_mix(
        chats=registry.read_chats(spark, chats) if chats else None,
        rows=registry.read_instruction_rows(spark, rows, rename=dict(rename or {})) if rows else None,
        jsonl=registry.read_chat_jsonl(spark, jsonl) if jsonl else None, seed=seed,
    )
    capped = instruct.capped_examples(mix, tokenizer).drop("messages")
    capped.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").parquet(out)


def pairs_job(spark: SparkSession, prefs: str, out: str, tokenizer: Tokenizer | None = None) -> None:
    """A6 + G6: a scanned preference set with both sides rendered and cut, written as Parquet."""
    pairs = instruct.preference_pairs(registry.read_preference_pairs(spark, prefs), tokenizer, with_tokens=True)
    pairs.write.mode("overwrite").parquet(out)


def _kv(items: Sequence[str]) -> dict[str, str]:
    out = {}
    for item in items:
        k, _, v = item.partition("=")
        out[k] = v
    return out


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="corpuspack")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("--source", action="append", required=True, help="name=path of a registered corpus")
    p.add_argument("--out", required=True)
    p.add_argument("--split", default=None)
    p.add_argument("--scale", default=None, help="mixture budgets: validate or full")
    p.add_argument("--target-tokens", type=int, default=packing.DEFAULT_TARGET)
    p.add_argument("--shard-tokens", type=int, default=packing.DEFAULT_SHARD_TOKENS)
    p.add_argument("--batch-docs", type=int, default=packing.DEFAULT_BATCH_DOCS)
    p.add_argument("--bin-dir", default=None)
    p.add_argument("--format", default="parquet", choices=["parquet", "json"])
    p.add_argument("--force", action="store_true")
    p.add_argument("--piece-tokens", type=int, default=None, help="also cut shards at its multiples (a divisor)")
    w = sub.add_parser("windows")
    src = w.add_mutually_exclusive_group(required=True)
    src.add_argument("--packed", help="packed Parquet folder")
    src.add_argument("--bin-dirs", help="comma-separated .bin shard folders, in data_dirs order")
    w.add_argument("--out", required=True)
    w.add_argument("--seq-len", type=int, default=2048)
    w.add_argument("--samples", type=int, default=None)
    w.add_argument("--epochs", type=float, default=1.0)
    w.add_argument("--seed", type=int, default=1337)
    w.add_argument("--micro-batch", type=int, default=8)
    w.add_argument("--grad-accum", type=int, default=1)
    w.add_argument("--ranks", type=int, default=1)
    w.add_argument("--piece-tokens", type=int, default=None, help="as given to prepare")
    w.add_argument("--source-order", default=None, help="comma-separated source names")
    g = sub.add_parser("prompts", help="seed prompts and their responses as chat JSONL")
    g.add_argument("--rows", required=True)
    g.add_argument("--responses", required=True)
    g.add_argument("--out", required=True)
    g.add_argument("--n", type=int, default=None)
    g.add_argument("--seed", type=int, default=0)
    g.add_argument("--rename", action="append", default=[], help="theirs=ours")
    t = sub.add_parser("tuning", help="the tuning set, rendered and cut")
    for name in ("--chats", "--rows", "--jsonl"):
        t.add_argument(name, default=None)
    t.add_argument("--out", required=True)
    t.add_argument("--seed", type=int, default=42)
    t.add_argument("--rename", action="append", default=[], help="theirs=ours")
    q = sub.add_parser("pairs", help="preference pairs, rendered and cut")
    q.add_argument("--prefs", required=True)
    q.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("corpuspack").getOrCreate()
    if args.cmd == "prepare":
        sources = _kv(args.source)
        targets = mixture.mixture_budgets(args.scale) if args.scale else args.target_tokens
        cut = prepare_corpus(spark, sources, args.out, targets, args.shard_tokens, args.batch_docs, args.split,
                             bin_dir=args.bin_dir, force=args.force, fmt=args.format, piece_tokens=args.piece_tokens)
        if cut is None:
            print(f"already prepared: {args.out}")
        else:
            for r in cut.orderBy("source").collect():
                budget = "no budget" if r.target is None else f"budget {r.target:,}"
                print(f"{r.source}: {r.n_shards} shards, {r.kept_tokens:,} ids ({budget})")
    elif args.cmd == "prompts":
        n = prompts_job(spark, args.rows, args.responses, args.out, args.n, args.seed, _kv(args.rename))
        print(f"took {n:,} prompts; chats in {args.out}")
    elif args.cmd == "tuning":
        tuning_job(spark, args.out, args.chats, args.rows, args.jsonl, args.seed, _kv(args.rename))
        print(f"tuning set in {args.out}")
    elif args.cmd == "pairs":
        pairs_job(spark, args.prefs, args.out)
        print(f"pairs in {args.out}")
    else:
        order = args.source_order.split(",") if args.source_order else None
        packed = args.bin_dirs.split(",") if args.bin_dirs else args.packed
        n = export_windows(spark, packed, args.out, args.seq_len, args.samples, args.epochs, args.seed,
                           args.micro_batch, args.grad_accum, args.ranks, source_order=order,
                           piece_tokens=args.piece_tokens)
        print(f"wrote {n:,} windows to {args.out}")


if __name__ == "__main__":
    main()
