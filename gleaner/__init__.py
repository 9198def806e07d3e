"""gleaner: tables of fetched web pages in, clean typed tables out, as Spark jobs."""
