"""What a run writes into its crawl log."""

CRAWLING, SUCCESS, FAILED, SKIPPED = "crawling", "success", "failed", "skipped"
DIRECTORY_ONLY = "directory-only: links extracted"
NO_CONTENT, NOT_CAPTURED = "no content", "not captured"

# Sentinel rows: address, status and message of a query that ends without results. {} is the phrase of the query.
UNSUPPORTED_URL, UNSUPPORTED = "unsupported:query", "unsupported"
UNSUPPORTED_ERROR = (
    'Query "{}" could not be mapped to any known industry or company. '
    'Try: "Find competitors of example.com", "Best Shopify agencies", or "AI companies".'
)
NO_NEW_URL, NO_NEW = "no_new_results:query", "no_new_results"
NO_NEW_ERROR = "No new companies found. All discovered results were already known from previous runs of this query."
