"""What an action writes to shuffles, by the session's own status store."""

from __future__ import annotations


def shuffled_bytes(spark, action) -> int:
    context = spark.sparkContext
    sc = context._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty()
        none = context._gateway.new_array(context._jvm.double, 0)
        stages = sc.statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    action()
    return total() - before
