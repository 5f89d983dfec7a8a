"""Comparing places: offset ranking, similarity, clusters, rule-weight scores, section views."""
