"""Fitted models: regression, classification, clustering, reduction, networks, optimizers."""
