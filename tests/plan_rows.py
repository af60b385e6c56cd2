"""How many rows the steps of a plan made, once it ran."""


def most_rows(df, metric: str = "numOutputRows") -> int:
    """The most rows that any one step of ``df`` gave (or another metric of steps); runs it."""
    df.collect()

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        below = [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get(metric)
        return max([own.get().value() if own.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())
