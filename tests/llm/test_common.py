from churnkit.llm import common as C


def test_a_cache_goes_when_a_task_does_not_ask(monkeypatch):
    monkeypatch.setattr(C.TaskCache, "every", [])
    made = []
    cache = C.TaskCache(lambda *args: made.append(args) or args)
    assert cache(1) == cache(1) == (1,) and made == [(1,)]
    list(C._tidy(iter(()), lambda batches: iter(())))       # the task that asked: kept
    assert cache(1) == (1,) and made == [(1,)]
    list(C._tidy(iter(()), lambda batches: iter(())))
    list(C._tidy(iter(()), lambda batches: iter(())))       # one that did not: gone
    assert cache.value is None and cache(1) == (1,) and made == [(1,), (1,)]
    assert cache(2) == (2,) and cache.args == (2,)
