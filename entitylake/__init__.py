"""Company discovery jobs over captured web pages, written as Spark plans."""
