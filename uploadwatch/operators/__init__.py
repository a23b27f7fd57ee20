"""Relational operators over detections, clusters, evidence and offenders."""
