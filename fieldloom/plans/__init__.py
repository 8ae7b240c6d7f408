"""Query catalog over the test tables and the matching oracle SQL."""
