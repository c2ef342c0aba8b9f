"""DataFrame operators over pages, jobs, products, images, requests and logs."""
