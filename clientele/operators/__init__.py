"""The analytic operators: features, scores, rules, queue, outcomes and reports."""
