"""Sources and sinks: dictionaries, fonts, pages, labels, manifests."""
