"""DataFrame operators. Work on the data runs in Spark; decisions are in ``tabwise.plans``."""
