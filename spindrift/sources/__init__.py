"""Where rows come from and go to: providers, crawled pages, caches, ledgers."""
