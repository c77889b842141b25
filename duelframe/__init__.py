"""DataFrame operators for randomised text experiments: pairs, features, ranking, drift."""

FEATURE_SPEC_VERSION = 1
