"""DataFrame-to-DataFrame operators and the few estimators that need a fit."""
