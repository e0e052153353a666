"""DataFrame operators: index, candidates, gradients, optimiser, model, matching, evaluation, loading checks, skew-free aggregates."""
