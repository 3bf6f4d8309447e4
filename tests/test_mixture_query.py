import inspect

from loamspark.operators import mixture as mx
from loamspark.plans import catalog


def test_mixture_fit_is_registered_with_the_reference_iterations(monkeypatch):
    calls, signature = [], inspect.signature(mx.fit)

    def fit(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        calls.append((bound.arguments["max_iter"], bound.arguments["tolerance"]))
        return [None]

    class Candidates:
        def cache(self):
            return self

    monkeypatch.setattr(catalog.mx, "fit", fit)
    monkeypatch.setattr(catalog.fx, "cand", lambda s, d: Candidates())
    monkeypatch.setattr(catalog, "rounded", lambda df: df)
    catalog.QUERIES["em_01_mixture_fit"](None, "")
    assert calls == [(200, 1e-6)]
