"""Schemas of the entities; every field may be null."""

HOP = "struct<url:string,status_code:int>"
PAGES = f"""url string, url_normalized string, final_url string, pos bigint, depth int, source string, crawl_run_id string, status_code int, content_type string,
ttfb_ms double, response_bytes bigint, redirect_chain array<{HOP}>, redirect_hops int, redirect_loop boolean, headers map<string,string>,
robots_txt_allowed boolean, meta_robots string, robots_directives array<string>, is_indexable boolean, indexability_reason string, is_noindex boolean, is_nofollow boolean,
canonical_url string, canonical_count int, title string, title_length int, meta_description string, meta_description_length int, h1_text string, h1_count int,
heading_outline array<struct<level:int,text:string>>, heading_hierarchy_gaps array<struct<from_level:int,to_level:int,skipped:array<int>>>, word_count int, main_text string, content_hash string,
hreflang_tags array<struct<lang:string,href:string>>, structured_data array<string>, structured_data_types array<string>,
img_count int, img_missing_alt int, img_lazy_broken int, img_missing_dimensions int, internal_links_count int, external_links_count int, internal_nofollow_count int,
was_rendered boolean, console_errors array<string>, raw_vs_rendered_diff struct<title_changed:boolean,h1_changed:boolean,canonical_changed:boolean,robots_changed:boolean,links_added:int,word_count_diff:int,has_significant_changes:boolean>,
mobile_checked boolean, mobile_diff struct<desktop_words:int,mobile_words:int,desktop_links:int,mobile_links:int>,
og_title string, og_description string, og_image string, og_url string, twitter_card string, twitter_title string, twitter_description string,
has_viewport boolean, viewport_content string, charset_declared string, pagination_next string, pagination_prev string, html_lang string, spa_framework string,
has_noscript_fallback boolean, has_mixed_content boolean, form_actions array<string>, empty_link_count int, form_inputs_without_label int, has_skip_nav boolean"""
LINKS = "crawl_run_id string, source_url string, dest_url string, dest_url_normalized string, anchor_text string, is_internal boolean, is_follow boolean, link_context string"
ROBOTS = "exists boolean, status_code int, parse_error string, sitemap_urls array<string>"
SITEMAP = "loc string, lastmod string, changefreq string, priority double, source string"
ISSUES = "crawl_run_id string, issue_type string, severity string, confidence double, affected_url string, affected_urls_count bigint, sample_urls array<string>, is_new boolean, is_regression boolean"
RUNS = "id string, site_id string, status string, created_at timestamp, completed_at timestamp, pages bigint, issue_counts map<string,bigint>"
METRICS = "crawl_run_id string, metric_name string, metric_value double"
SITES = "id string, tenant_id string, name string, start_urls array<string>, domain string, is_active boolean"
POLICIES = "site_id string, max_pages int, max_depth int, concurrency int, rate double, render_mode string, allow array<string>, deny array<string>, schedule_cron string"
MEMORY = "id string, site_url string, page_url string, action_type string, action_value string, context_text string, job_id string, embedding array<float>, before_metrics struct<gsc_ctr:double,gsc_position:double,gsc_impressions:double>, reward_score double, action_taken_at timestamp"
GSC = "url string, gsc_clicks int, gsc_impressions int, gsc_ctr double, gsc_position double"
PSI = "url string, psi_score int, psi_lcp_ms int, psi_cls double, psi_inp_ms int, psi_fcp_ms int, psi_ttfb_ms int, psi_strategy string"
ANSWERS = "pos bigint, prompt_id string, persona string, region string, service string, prompt_type string, final_text string, answer_text string"
TRACKER_RUN = "prompt_id string, original_query string, prompt_type string, prompt_text string, response string, success boolean, latency_ms double, cosine_score double, timestamp string"
