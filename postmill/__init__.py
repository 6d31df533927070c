"""postmill: job-posting analytics as Spark jobs.

Column transforms live in ``functions``, feed readers in ``sources``, table jobs in
``operators``, end-to-end runs in ``plans`` and incremental runs in ``streaming``.
Everything is ``DataFrame(s) + parameters -> DataFrame``; the moment a job is judged
at (``as_of``) is always a parameter, so a rerun gives the same rows.
"""
