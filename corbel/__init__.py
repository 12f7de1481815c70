"""corbel: catalog grounding as Spark jobs.

Sources turn manifests, token files, markdown and alias lists into flat
DataFrames; operators resolve, merge, rank, lint and audit them in bulk.
"""
