"""Ready-made jobs over the test tables, each paired with SQL that checks it."""
