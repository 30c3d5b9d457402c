"""Stored stages and the driver's memory."""

import re
from pathlib import Path

import pytest

from tally_spark.plans import store

BLOCK, BLOCKS = 64 << 10, 6000


@pytest.mark.parametrize("keep", [store.stored, lambda df, name: store.stored_together([df], name)])
def test_free_native_memory_goes_back_to_the_system(spark, keep):
    jvm = spark._jvm
    at = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", at.read_text())[1]) / 1024
    keep(spark.range(1), "warm")
    memory = jvm.org.apache.spark.unsafe.Platform
    blocks = [memory.allocateMemory(BLOCK) for _ in range(BLOCKS)]
    for b in blocks[1:]:
        memory.copyMemory(None, blocks[0], None, b, BLOCK)
    # the last one stays for now, so that malloc can't cut off the end of its arena
    for b in blocks[:-1]:
        memory.freeMemory(b)
    before = held()
    assert [r.id for r in keep(spark.range(1), "after").collect()] == [0]
    after = held()
    memory.freeMemory(blocks[-1])
    assert after < before - 0.5 * BLOCK * BLOCKS / (1 << 20)
