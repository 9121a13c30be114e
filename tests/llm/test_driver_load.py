"""What the driver plans and keeps stays small, however few the rows."""

import os
import re

from emberlog.llm import common, pii


def test_kinds_are_planned_together(spark):
    docs = spark.createDataFrame([(1, "write to a.b@example.org or call +44 20 7946 0958, card 4111 1111 1111 1111"), (2, None)], "doc_id long, text string")
    found = pii.detect(docs)
    assert [[s.kind for s in r.pii_spans] for r in found.orderBy("doc_id").collect()] == [["email", "card", "phone"], []]
    assert found.columns == ["doc_id", "text", "pii_spans"]
    assert found._jdf.queryExecution().analyzed().toString().count("Project [") <= 12


def test_tidy_gives_freed_memory_back(spark):
    jvm, pid = spark._jvm, int(spark._jvm.ProcessHandle.current().pid())
    used = lambda: int(re.search(r"VmRSS:\s+(\d+)", open(f"/proc/{pid}/status").read())[1]) // 1024 if os.path.exists(f"/proc/{pid}/status") else 0  # noqa: E731, SIM115
    field = jvm.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, size = field.get(None), 64 << 10  # below what the C library maps by itself
    common.tidy(spark)
    places = [unsafe.allocateMemory(size) for _ in range(2000)]
    for p in places:
        unsafe.setMemory(p, size, 1)
    full = used()
    for p in places[:-1]:  # the last one keeps the heap's end where it is
        unsafe.freeMemory(p)
    common.tidy(spark)
    after = used()
    unsafe.freeMemory(places[-1])
    assert not full or after < full - 80
