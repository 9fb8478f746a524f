"""Property tests: demux then concatenate is the identity; index starts are gap-free."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from actlake.operators import demux as D
from actlake.operators.layout import index_offsets

batches = st.lists(st.lists(st.integers(min_value=0, max_value=6), min_size=0, max_size=5), min_size=1, max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches)
def test_demux_then_concat_is_identity(spark, lens_per_batch):
    meta_rows, tok_rows, pid = [], [], 0
    for b, lens in enumerate(lens_per_batch):
        rids = []
        for _ in lens:
            rids.append(f"{pid}|0")
            pid += 1
        meta_rows.append((b, 0, 0, rids, lens, [0] * len(lens)))
        tok_rows += [(b, i, [float(b), float(i)]) for i in range(sum(lens))]
    meta = spark.createDataFrame(meta_rows, "batch_id long, gpu_id long, global_rank long, rids array<string>, "
                                            "seq_lens array<int>, prefix_lens array<int>")
    toks = spark.createDataFrame(tok_rows, "batch_id long, flat_pos int, vec array<float>")
    out = D.demux(toks, meta).collect()
    # concatenating each batch's sequences in rid order gives back the flat tensor
    by_batch = {}
    for r in sorted(out, key=lambda r: (r.batch_id, r.prompt_id, r.token_pos)):
        by_batch.setdefault(r.batch_id, []).append(tuple(r.vec))
    for b, lens in enumerate(lens_per_batch):
        assert by_batch.get(b, []) == [(float(b), float(i)) for i in range(sum(lens))]
    sl = {(r.batch_id, r.prompt_id): (r.start, r.seq_len) for r in D.sequence_slices(meta).collect()}
    assert all(n > 0 for _, n in sl.values())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([16, 32]), st.integers(min_value=0, max_value=50)), min_size=1, max_size=40))
def test_index_starts_are_gap_free(spark, rows):
    data = [(i, 0, layer, n, i) for i, (layer, n) in enumerate(rows)]
    df = spark.createDataFrame(data, "prompt_id long, completion_idx int, layer int, n_tokens int, append_ord long")
    got = index_offsets(df, "append_ord", partition=("layer",), n_buckets=3).collect()
    for layer in (16, 32):
        seq = sorted((r.append_ord, r.start, r.n_tokens) for r in got if r.layer == layer)
        end = 0
        for _, start, n in seq:
            assert start == end
            end += n


def test_index_offsets_continue_after_existing_end(spark):
    df = spark.createDataFrame([(1, 0, 16, 4, 1), (2, 0, 16, 3, 2), (1, 0, 32, 5, 1)],
                               "prompt_id long, completion_idx int, layer int, n_tokens int, append_ord long")
    prior = spark.createDataFrame([(16, 100)], "layer int, end long")
    got = {(r.layer, r.prompt_id): r.start for r in index_offsets(df, "append_ord", prior_end=prior).collect()}
    assert got == {(16, 1): 100, (16, 2): 104, (32, 1): 0}
