"""Python workers outlive tasks: what a task took goes back to the system."""

import pyarrow as pa

from siltstone.llm import common


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_memory_goes_back_at_the_end_of_a_task():
    def run(batches):
        for batch in batches:
            held = [f"{i}-{'x' * 90}" for i in range(1_500_000)]
            arrow = pa.array(held)
            seen.append(resident())
            del held, arrow
            yield batch

    seen = []
    at = resident()
    assert len(list(common.thrifty(run)(iter([pa.record_batch({"a": [1]})])))) == 1
    assert seen[0] - at > 200e6 and resident() - at < 0.3 * (seen[0] - at)
